"""Token counts through a digest cache.

The cache is a folder of (version, digest, n_tokens).  The digest is SHA-256 of the text as
the tokenizer sees it (null is the empty text; nothing else may be folded without changing
counts), the version is SHA-256 of the library name and the vocabulary file.  Texts are
joined to stored counts, each distinct miss is encoded once and appended; a second run over
the same texts encodes nothing.  Appends are whole files, so a run that dies leaves a valid
cache; a pair stored twice is read once.

Inside a task the distinct space-led parts of some texts are encoded once: when no piece of
the vocabulary has the space mark after another character, the count of a text is the sum
over its parts.  That is checked on the vocabulary and on probes when it is loaded;
otherwise, and for texts with a literal mark, texts are encoded whole.
"""
from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import pyarrow as pa
import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh_path, join_counted
from .tokens import slices

MARK = "▁"
PART = re.compile(r" *[^ ]+| +$")
PROBES = ["a b", " a", "a ", "  a   b  ", "a\nb c\t d", " a 　b  ", "é ﬁx  y", "", " ", "\n \n", "<s> a </s>"]


def version_of(name: str) -> str:
    kind = "tokenizers" if name.endswith(".json") else "sentencepiece"
    with open(public_tokenizers.path(name), "rb") as f:
        return hashlib.sha256(kind.encode() + b"\0" + f.read()).hexdigest()


def counter(name: str) -> Callable[[list[str]], list[int]]:
    """texts -> token counts as the library gives them, without added special tokens."""
    path = public_tokenizers.path(name)
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        return lambda texts: [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)

    def whole(texts: list[str]) -> list[int]:
        return [len(x) for x in sp.encode(texts, num_threads=1)]

    def by_parts(texts: list[str]) -> list[int]:
        known: dict[str, int] = {}
        cut_up: list[list[str] | None] = []
        for t in texts:
            if MARK in t:
                cut_up.append(None)
                continue
            parts = PART.findall(t)
            # the library puts one mark in front of a text; a later part brings its own
            parts[1:] = [p[1:] for p in parts[1:]]
            cut_up.append(parts)
            known.update(dict.fromkeys(parts, 0))
        names = list(known)
        known = dict(zip(names, whole(names)))
        known[""] = 1  # a single space at the end of a text is one mark
        odd = iter(whole([t for t, parts in zip(texts, cut_up) if parts is None]))
        return [next(odd) if parts is None else sum(map(known.__getitem__, parts)) for parts in cut_up]

    apart = all(MARK not in sp.id_to_piece(i).lstrip(MARK) for i in range(sp.get_piece_size()))
    return by_parts if apart and by_parts(PROBES) == whole(PROBES) else whole


def _encode(name: str, version: str):
    def run(batches):
        count = counter(name)
        for b in batches:
            texts = b.column(1)
            for lo, hi, _, _ in slices(texts, 1 << 21):
                n = hi - lo
                yield pa.RecordBatch.from_arrays(
                    [pa.array([version] * n), b.column(0).slice(lo, n), pa.array(count([t or "" for t in texts.slice(lo, n).to_pylist()]), pa.int64())],
                    names=["version", "digest", "n_tokens"],
                )

    return run


def _digest():
    return F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))


SCHEMA = "version string, digest binary, n_tokens bigint"


def stored(spark, cache: str) -> DataFrame:
    """What the cache holds; an absent folder holds nothing."""
    try:
        return spark.read.schema(SCHEMA).parquet(cache)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], SCHEMA)


def refresh(docs: DataFrame, name: str, cache: str) -> DataFrame:
    """Encode the distinct texts of `docs` that the cache lacks, append them; the counts of this version."""
    version = version_of(name)
    held = stored(docs.sparkSession, cache).filter(F.col("version") == version).select("digest")
    texts = docs.select(_digest().alias("digest"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    # one text per digest: combined map-side, so a text held by a third of all rows costs one row per task
    misses = texts.groupBy("digest").agg(F.first("text").alias("text")).join(held, "digest", "left_anti")
    misses.mapInArrow(_encode(name, version), SCHEMA).write.mode("append").parquet(cache)
    counts = stored(docs.sparkSession, cache).filter(F.col("version") == version)
    return counts.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def token_counts(docs: DataFrame, name: str = "piece_bpe_32k.model", cache: str | None = None, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit: one row per input row.

    `cache` is the folder of stored counts; without one, the folder that the session names in
    `fraudloom.token.cache`, else a new one.
    """
    spark = docs.sparkSession
    cache = cache or spark.conf.get("fraudloom.token.cache", None) or fresh_path(spark, "token-cache")
    counts = refresh(docs, name, cache)
    slim = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"), _digest().alias("digest"))
    # a text held by many rows is not one task of the join
    known = cut(slim.groupBy("digest").agg(F.count(F.lit(1)).alias("copies")).join(counts, "digest"))
    return join_counted(slim, known, "digest", "copies").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
