"""The corpus pipeline: stages over ``documents``, each on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestack.llm import decontaminate, language, pieces, repeats, similar, simhash
from lodestack.llm.workspace import materialise, unused

#: Documents whose language is less sure than this are rejected, as are those of no language.
LEAST_SCORE = 0.5
#: Words of a passage that counts as repeated: over 50.
PASSAGE_WORDS = 51


def language_id(spark, docs, sf_dir):
    """Documents without a letter or of unsure language go; columns stay as they are."""
    model = language.train_on_documents(docs)
    lang, score = unused(docs, "lang_pred"), unused(docs, "score")
    judged = language.predict(docs, model, lang_to=lang, score_to=score)
    return judged.where((F.col(lang) != language.UNDETERMINED) & (F.col(score) >= LEAST_SCORE)).select(*docs.columns)


def near_dedup(spark, docs, sf_dir):
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more) stays, the one with the least id.

    SimHash fingerprints of the shingles within ``similar.RADIUS`` bits nominate pairs, MinHash bands those further apart; exact similarity decides.
    """
    return simhash.drop_near_duplicates(docs, components=similar.similar_components)


def cut_repeats(spark, docs, sf_dir):
    """Strings of 400 bytes and passages of over 50 words that start at two or more places are cut out of the texts; emptied documents stay empty."""
    return repeats.remove_repeats(docs, words=PASSAGE_WORDS)


def decontamination(spark, docs, sf_dir):
    """Documents that contain an item of the benchmark go."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding(spark, docs, sf_dir):
    """(doc_id, n_pieces, piece_ids, decoded_sha256, same): the pieces of each text that is left."""
    import public_tokenizers

    return pieces.round_trip(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("language ID", language_id),
    ("near-dedup", near_dedup),
    ("suffix-array dedup", cut_repeats),
    ("benchmark decontamination", decontamination),
    ("SentencePiece encoding and decoding", encoding),
]
ORACLE_SQL = None


def run(spark, sf_dir):
    """The rows of the last stage over the table documents of ``sf_dir``, each stage written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
