"""Token counts through a digest cache.

A document's text (null: empty) is named by its SHA-256 and the tokenizer by the SHA-256 of its file, so
that a new tokenizer version never meets old counts. Distinct digests are joined to the cache; the texts
of the misses alone, one per digest, are encoded, and their counts are appended to the cache, a Parquet
table in the shared folder. Normalisation leaves a text as it is: any change could change its count.

The exact copies of a text, be they a third of all rows, are combined before the shuffle (one text per
digest and map task). Every document's count is then read from the cache; digests of very many rows (HOT rows at
least, and a HOT_SHARE of all) have their counts broadcast, the others are joined by shuffle. Encoding is in
Arrow batches bounded by bytes, never by cutting a text.

Cases: null and empty texts have 0 bytes and 0 tokens; repeated rows each get a row; an empty table gives
an empty result; other columns are ignored; a null doc_id is kept.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import materialise, scratch_path
from corpusloom.session import table

PIECES = "piece_bpe_32k.model"
CACHE_SCHEMA = "tokenizer string, digest binary, n_tokens long"
#: A digest is hot from so many rows on, and from this share of all rows on (so at most 10,000 are broadcast).
HOT, HOT_SHARE = 100, 1e-4
#: Words whose counts a worker remembers; beyond it the memory starts anew.
WORDS_KEPT = 400_000


def splits_at_blanks(model: bytes) -> bool:
    """Whether the model's settings let a text be counted word by word."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    m = proto.ModelProto()
    m.ParseFromString(model)
    n, t, kinds = m.normalizer_spec, m.trainer_spec, proto.ModelProto.SentencePiece
    plain = not n.precompiled_charsmap and not n.normalization_rule_tsv and not n.remove_extra_whitespaces and n.escape_whitespaces and n.add_dummy_prefix
    bpe = t.model_type == proto.TrainerSpec.BPE and not t.treat_whitespace_as_suffix and not t.user_defined_symbols
    return bool(plain and bpe and all(p.type != kinds.USER_DEFINED and "▁" not in p.piece.lstrip("▁") for p in m.pieces))


class PieceCounter:
    """Counts of a SentencePiece BPE model, word by word where that is provably the same.

    The model's own settings decide: a BPE model without user-defined pieces, whose normaliser has no rules and
    keeps blanks, turning each to a mark, and puts one in front; and pieces that hold marks only at their start.
    Then the symbols before merging are those of the text, and no merge spans the start of a run of marks, so a
    text's count is the sum over its runs of blanks followed by a word. Other models, and texts to which it does
    not apply, are encoded whole.
    """

    def __init__(self, model: str) -> None:
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.by_word = splits_at_blanks(self.sp.serialized_model_proto())
        self.known: dict[str, int] = {}

    def count(self, text: str) -> int:
        if not self.by_word or "▁" in text or text.endswith(" ") or "\0" in text:
            return len(self.sp.encode(text))
        words = text.split(" ") if "  " not in text and text[:1] != " " else [x[1:] for x in re.findall(" +[^ ]*", " " + text)]
        known, total = self.known, 0
        for w in words:
            n = known.get(w)
            if n is None:
                n = len(self.sp.encode(w))
                if len(w) < 64:
                    if len(known) >= WORDS_KEPT:
                        known.clear()
                    known[w] = n
            total += n
        return total


class WholeCounter:
    """Counts of a `tokenizers` file."""

    def __init__(self, model: str) -> None:
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(model)
        self.tok.no_truncation()
        self.tok.no_padding()

    def count(self, text: str) -> int:
        return len(self.tok.encode(text, add_special_tokens=False).ids)


_counters: dict[str, PieceCounter | WholeCounter] = {}


def counter(model: str) -> PieceCounter | WholeCounter:
    if model not in _counters:
        _counters[model] = PieceCounter(model) if model.endswith(".model") else WholeCounter(model)
    return _counters[model]


def tokenizer_path(name: str) -> str:
    """A public tokenizer's file; every machine has the package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer_digest(model: str) -> str:
    with open(model, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def count_misses(misses: DataFrame, name: str, version: str) -> DataFrame:
    """Cache rows of distinct (digest, text)."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = counter(tokenizer_path(name))
        for batch in batches:
            counts = [tok.count(x.as_py()) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array([version] * len(counts), pa.string()), batch.column("digest"), pa.array(counts, pa.int64())], ["tokenizer", "digest", "n_tokens"])

    return misses.select("digest", "text").mapInArrow(encode, CACHE_SCHEMA)


def named_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text, digest); null texts are empty."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("digest", F.unhex(F.sha2(F.col("text"), 256)))


def stored_counts(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """Cache rows of a tokenizer."""
    return spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("tokenizer") == version)


def append_misses(named: DataFrame, name: str, version: str, cache: str) -> None:
    """Encodes the distinct texts whose digests the cache does not hold, and appends their counts."""
    spark = named.sparkSession
    spark.createDataFrame(pd.DataFrame({"tokenizer": [], "digest": [], "n_tokens": []}), CACHE_SCHEMA).write.mode("append").parquet(cache)
    distinct = named.groupBy("digest").agg(F.first("text").alias("text"))
    misses = distinct.join(stored_counts(spark, cache, version).select("digest"), "digest", "left_anti")
    count_misses(misses, name, version).write.mode("append").parquet(cache)


def token_counts(docs: DataFrame, name: str = PIECES, cache: str | None = None, limit: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, digest) of every document; new counts are appended to the Parquet table at `cache`.

    cache: a path in a shared store, kept between runs; None: a new one in the shared folder. Two runs
    that append the same digest leave equal rows, which are read as one.
    """
    spark = docs.sparkSession
    version = tokenizer_digest(tokenizer_path(name))
    cache = cache or scratch_path(spark, "token-cache")
    named = named_texts(docs)
    append_misses(named, name, version, cache)
    counts = stored_counts(spark, cache, version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    rows = materialise(named.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes")), "digests")
    many = rows.groupBy("digest").count().where(F.col("count") >= max(HOT, math.ceil(HOT_SHARE * rows.count())))
    hot = materialise(counts.join(many, "digest").select(F.col("digest").alias("hot"), F.col("n_tokens").alias("hot_tokens")), "hot-counts")
    rows = rows.join(F.broadcast(hot), F.col("digest") == F.col("hot"), "left")
    # A hot row has a key of its own, which no digest equals, so hot rows are spread and meet nothing.
    own = F.when(F.col("hot").isNull(), F.col("digest")).otherwise(F.monotonically_increasing_id().cast("string").cast("binary"))
    found = rows.withColumn("key", own).join(counts.withColumnRenamed("digest", "key"), "key", "left").withColumn("n_tokens", F.coalesce("hot_tokens", "n_tokens"))
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "digest")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every whole document by the 32k piece model."""
    return token_counts(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_tokens", "over_limit")
