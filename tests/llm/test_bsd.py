"""The BSD licenses are told apart by their clauses."""

from lodestack.llm import licenses as lic

OPENING = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
"""
SECOND = """2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
THIRD = """3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""


def test_clauses_set_the_license():
    scanner = lic.Scanner(lic.TEMPLATES)
    for text, name in ((OPENING + SECOND, "BSD-2-Clause"), (OPENING + SECOND + THIRD, "BSD-3-Clause"), (OPENING, "BSD-header")):
        assert [hit[0] for hit in scanner.scan(f"some words before {text} and after")] == [name]
