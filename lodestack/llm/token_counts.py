"""Token counts by rank-synchronous merging of ragged symbol arrays."""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm.batches import released, text_pieces

#: Distinct pre-tokens whose counts a worker remembers; beyond it the memory starts anew.
REMEMBERED = 300_000
NO_RANK = np.int64(1 << 40)


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte value."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    shifted = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(shifted)) for b in range(256)]


#: Code points whose classes are compared at a time.
CLASS_BLOCK = 1 << 14


def differing(normalizer, classes: tuple[str, ...]) -> list[str]:
    """The characters that the library's tables put in another class, or normalize otherwise, than Python's do."""
    out: set[str] = set()
    whole = "".join(chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000)
    for at in range(0, len(whole), CLASS_BLOCK):
        block = whole[at : at + CLASS_BLOCK]
        for name in classes:
            rest = tokenizers.pre_tokenizers.Split(tokenizers.Regex(name), "removed").pre_tokenize_str(block)
            theirs = np.ones(len(block), bool)
            for _, (a, b) in rest:
                theirs[a:b] = False
            ours = np.zeros(len(block), bool)
            ours[[m.start() for m in regex.finditer(name.replace(r"\s", r"\p{White_Space}"), block)]] = True
            out.update(block[k] for k in np.flatnonzero(theirs != ours).tolist())
        # a letter keeps the characters apart where they are normalized
        plain = [unicodedata.normalize("NFC", c).replace("Σ", "σ").lower() for c in block]
        if normalizer.normalize_str("x".join(block)) != "x".join(" " if c.isspace() and regex.fullmatch(r"\p{White_Space}", c) else p for c, p in zip(block, plain)):
            out.update(c for c, p in zip(block, plain) if normalizer.normalize_str(c) != p and not regex.fullmatch(r"\p{White_Space}", c))
    return sorted(out)


def any_of(chars: list[str]) -> re.Pattern:
    """A pattern for one of the sorted characters, as runs of code points."""
    runs: list[list[int]] = []
    for c in map(ord, chars):
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return re.compile("[" + "".join(f"{re.escape(chr(a))}-{re.escape(chr(z))}" for a, z in runs) + "]" if runs else "(?!)")


class WordBpe:
    """Counts tokens as a byte-level BPE tokenizer file with word-end symbols gives them.

    The file's normalizer (NFC, runs of white space as one space, lower case),
    its split pattern, its merges and its special tokens are read from ``path``.
    Parts of texts with a character that the library's Unicode tables class
    otherwise than Python's are normalized and split by the library.
    """

    def __init__(self, path: str):
        spec = json.loads(open(path, encoding="utf-8").read())
        model, end = spec["model"], spec["model"]["end_of_word_suffix"]
        vocab, letters = model["vocab"], byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.final = np.array([vocab[c + end] for c in letters], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.base = len(vocab) + 1
        keys = np.array([vocab[a] * self.base + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made
        self.specials = regex.compile("|".join(regex.escape(t["content"]) for t in spec["added_tokens"]))
        self.spaces = regex.compile(r"\p{White_Space}+")
        split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.split = regex.compile(split.replace(r"\s", r"\p{White_Space}"))
        self.normalizer = tokenizers.Tokenizer.from_file(path).normalizer
        self.library_split = tokenizers.pre_tokenizers.Split(tokenizers.Regex(split), "removed", invert=True)
        self.odd = any_of(differing(self.normalizer, (r"\p{L}", r"\p{N}", r"\s")))
        self.known: dict[str, int] = {}

    def pre_tokens(self, text: str) -> tuple[list[str], int]:
        """The pre-tokens of a whole text, and the number of special tokens in it."""
        parts = self.specials.split(text)
        words: list[str] = []
        for part in parts:
            if not part.isascii() and self.odd.search(part):
                words += [w for w, _ in self.library_split.pre_tokenize_str(self.normalizer.normalize_str(part))]
                continue
            if not part.isascii():
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
            words += self.split.findall(self.spaces.sub(" ", part).lower())
        return words, len(parts) - 1

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.base + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NO_RANK)

    def merged_counts(self, words: list[str]) -> np.ndarray:
        """Symbols that survive in each pre-token; all pre-tokens merge in step.

        Each step applies, in every pre-token, its pair of lowest rank wherever
        it stands (overlaps from the left), and drops pre-tokens that are done.
        """
        raw = [w.encode() for w in words]
        size = np.array([len(x) for x in raw], np.int64)
        flat = np.frombuffer(b"".join(raw), np.uint8)
        ids = self.inner[flat]
        last = np.cumsum(size) - 1
        ids[last] = self.final[flat[last]]
        out, who = size.copy(), np.arange(len(words))
        tail = np.zeros(len(ids), bool)
        tail[last] = True
        ranks = np.append(self.rank(ids[:-1], ids[1:]), NO_RANK)
        ranks[last] = NO_RANK
        while len(who):
            start = np.cumsum(size) - size
            low = np.minimum.reduceat(ranks, start)
            live = low < NO_RANK
            out[who[~live]] = size[~live]
            if not live.all():
                keep = np.repeat(live, size)
                ids, tail, ranks = ids[keep], tail[keep], ranks[keep]
                who, size, low = who[live], size[live], low[live]
                if not len(who):
                    break
            hit = ranks == np.repeat(low, size)
            clash = hit[1:] & hit[:-1]
            if clash.any():  # equal symbols in a row: every second pair of the run
                at = np.arange(len(hit))
                first = np.maximum.accumulate(np.where(hit & ~np.r_[False, hit[:-1]], at, 0))
                hit &= (at - first) % 2 == 0
            spot = np.flatnonzero(hit)
            ids[spot] = self.made[ranks[spot]]
            tail[spot] = tail[spot + 1]
            gone = np.zeros(len(ids), bool)
            gone[spot + 1] = True
            lost = np.add.reduceat(gone.astype(np.int64), np.cumsum(size) - size)
            stay = ~gone
            spot = np.cumsum(stay)[spot] - 1
            ids, tail, ranks = ids[stay], tail[stay], ranks[stay]
            size = size - lost
            near = np.union1d(spot, np.maximum(spot - 1, 0))
            ranks[near] = np.where(tail[near], NO_RANK, self.rank(ids[near], ids[np.minimum(near + 1, len(ids) - 1)]))
        return out

    def count(self, texts: list[str | None]) -> list[int]:
        """Tokens of each whole text; nulls and empty texts have none."""
        split = [self.pre_tokens(t or "") for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = list({w for words, _ in split for w in words} - self.known.keys())
        if new:
            self.known.update(zip(new, self.merged_counts(new).tolist()))
        return [sum(map(self.known.__getitem__, words)) + extra for words, extra in split]


@functools.lru_cache(2)
def _loaded(path: str) -> WordBpe:
    return WordBpe(path)


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of ``docs``.

    ``tokenizer`` is the path of the vocabulary file on every executor. Null
    texts count as empty; empty texts have no tokens; special strings inside a
    text are one token each; repeated rows are counted each; a null id stays
    null. Other columns of ``docs`` are not looked at.
    """

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(tokenizer)
        for batch in batches:
            for piece in text_pieces(batch):
                n = np.array(bpe.count(piece.column(1).to_pylist()), np.int64)
                size = np.nan_to_num(pa.compute.binary_length(piece.column(1)).to_numpy(zero_copy_only=False)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(size), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema[0].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")


def op9_token_counts(spark, sf_dir):
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return count_tokens(docs, public_tokenizers.path("word_bpe_49k.json"))
