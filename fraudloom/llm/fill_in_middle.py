"""Fill-in-middle transformation with memoised content-defined chunks.

A text is cut into chunks where a rolling hash of its last `WINDOW` bytes has its top bits
zero (2 KB on average, `LONGEST` at most), so equal passages of different texts give equal
chunks.  A task keeps a cache from the content of a chunk to its summary: code points that
begin in it, whether it holds a mark, its first and last two bytes.  A chunk met again is
compared by content, not by hash alone.  Summaries are put together from left to right: the
running count of code points is the length of the text and says in which chunks the two cuts
lie; only those are looked into.  The last and first bytes show a mark across a boundary.

The cache is per task and starts anew when full, which changes no result.  One cache for all
tasks would send every chunk through a shuffle to save a pass that costs less than the shuffle.

Cut points and form come from the id alone (`draws`), so reruns and lost executors give the
same rows.  Defined cases: a null text is empty and stays plain; a null id draws as the empty
text; repeated rows give equal outputs.
"""
from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tokens import slices

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
MARKS = (PREFIX, SUFFIX, MIDDLE)
WINDOW, CUT_BITS, LONGEST = 16, 11, 1 << 15
CACHE_BYTES = 32 << 20
GEAR = np.random.Generator(np.random.PCG64(12)).integers(0, 1 << 32, 256, dtype=np.uint32)
INNER = bytes(range(0x80, 0xC0))  # bytes that continue a code point


def cut_places(raw: np.ndarray) -> np.ndarray:
    """Places behind which the rolling hash ends a chunk; bit i of the sum is reached by the last i + 1 bytes."""
    x = GEAR[raw]
    step = 1
    while step < WINDOW:
        y = x.copy()
        y[step:] += x[:-step] << np.uint32(step)
        x, step = y, step * 2
    return np.flatnonzero(x >> np.uint32(32 - CUT_BITS) == 0) + 1


def chunks(begin: int, end: int, places: np.ndarray) -> list[int]:
    """Chunk borders of the text at begin..end; the first WINDOW bytes never end one, since the hash looks back beyond the text there."""
    lo, hi = np.searchsorted(places, (begin + WINDOW, end))
    borders = [begin]
    for p in [*places[lo:hi].tolist(), end]:
        while p - borders[-1] > LONGEST:
            borders.append(borders[-1] + LONGEST)
        if p > borders[-1]:
            borders.append(p)
    return borders


def summary(chunk: bytes) -> tuple[int, bool, bytes, bytes]:
    return len(chunk.translate(None, INNER)), any(m in chunk for m in MARKS), chunk[:2], chunk[-2:]


class Memo:
    """Chunk content -> summary, bounded by bytes of content."""

    def __init__(self, limit: int = CACHE_BYTES):
        self.limit, self.held, self.met, self.known = limit, 0, 0, {}

    def of(self, chunk: bytes) -> tuple[int, bool, bytes, bytes]:
        got = self.known.get(chunk)  # equal hashes are told apart by content
        if got is not None:
            self.met += 1
            return got
        if self.held > self.limit:
            self.known.clear()
            self.held = 0
        self.held += len(chunk)
        got = self.known[chunk] = summary(chunk)
        return got


def measure(buf: bytes, borders: list[int], memo: Memo) -> tuple[list[int], bool]:
    """(running count of code points at every border, whether a mark occurs)."""
    counts, marked, tail = [0], False, b""
    for a, b in zip(borders[:-1], borders[1:]):
        n, has, head, end = memo.of(buf[a:b])
        across = tail + head
        marked |= has or any(m in across for m in MARKS)
        counts.append(counts[-1] + n)
        tail = (tail + end)[-2:]
    return counts, marked


def locate(buf: bytes, borders: list[int], counts: list[int], points: int) -> int:
    """Byte at which the code point number `points` begins; the end of the text if there is none."""
    if points >= counts[-1]:
        return borders[-1]
    i = bisect.bisect_right(counts, points) - 1
    part = np.frombuffer(buf, np.uint8, borders[i + 1] - borders[i], borders[i])
    return borders[i] + int(np.flatnonzero((part & 0xC0) != 0x80)[points - counts[i]])


def _transform(keys: int):
    """(keys..., text, h1, h2, wanted) -> (keys..., n, form, prefix_chars, middle_chars, output)."""

    def run(batches):
        memo = Memo()
        for b in batches:
            text, h1, h2, wanted = b.columns[keys : keys + 4]
            for lo, hi, raw, off in slices(text):
                buf, places, rows = raw.tobytes(), cut_places(raw), []
                for i in range(hi - lo):
                    a, z = int(off[i]), int(off[i + 1])
                    borders = chunks(a, z, places) if z > a else [a]
                    counts, marked = measure(buf, borders, memo)
                    n, form = counts[-1], wanted[lo + i].as_py()
                    if not n or marked or form == "plain":
                        rows.append((n, "plain", None, None, buf[a:z]))
                        continue
                    first, last = sorted((h1[lo + i].as_py() % (n + 1), h2[lo + i].as_py() % (n + 1)))
                    p, q = locate(buf, borders, counts, first), locate(buf, borders, counts, last)
                    prefix, middle, suffix = buf[a:p], buf[p:q], buf[q:z]
                    whole = (PREFIX, prefix, SUFFIX, suffix) if form == "psm" else (SUFFIX, suffix, PREFIX, prefix)
                    rows.append((n, form, first, last - first, b"".join((*whole, MIDDLE, middle))))
                if rows:
                    n, form, first, middle, out = zip(*rows)
                    yield pa.RecordBatch.from_arrays(
                        [*[c.slice(lo, hi - lo) for c in b.columns[:keys]], pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(first, pa.int64()), pa.array(middle, pa.int64()), pa.array(out, pa.binary()).cast(pa.string())],
                        names=[*b.schema.names[:keys], "n", "form", "prefix_chars", "middle_chars", "output"],
                    )

    return run


def draws(name: str = "doc_id", salt: str = "1:") -> list[Column]:
    """Four 32-bit numbers from the hex sha256 of the salt and the decimal id."""
    digest = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col(name).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(4)]


def fill_in_middle(docs: DataFrame, rate: int = 90, spm: int = 20, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keys..., n, form, prefix_chars, middle_chars, output: one row per input row.

    `rate` of 100 texts are transformed, `spm` of 100 of those with the suffix first.
    """
    h1, h2, h3, h4 = draws()
    wanted = F.when(h3 % 100 >= rate, "plain").when(h4 % 100 < spm, "spm").otherwise("psm")
    src = docs.select(*keys, "text", h1.alias("__h1"), h2.alias("__h2"), wanted.alias("__form"))
    form = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys)
    return src.mapInArrow(_transform(len(keys)), f"{form}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restored(output: str = "output", form: str = "form") -> Column:
    """The text that an output was made from; a transformed text holds no mark of its own."""
    part = F.split(F.col(output), "<[PSM]>", -1)
    at = lambda i: F.coalesce(F.try_element_at(part, F.lit(i)), F.lit(""))
    return F.when(F.col(form) == "plain", F.col(output)).when(F.col(form) == "psm", F.concat(at(2), at(4), at(3))).otherwise(F.concat(at(3), at(4), at(2)))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256."""
    out = fill_in_middle(docs)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT doc_id, t, CAST(length(t) AS BIGINT) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
f AS (SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS p, greatest(h1 % (n + 1), h2 % (n + 1)) AS q,
  CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
o AS (SELECT *, substring(t, 1, p) AS pre, substring(t, p + 1, q - p) AS mid, substring(t, q + 1, n - q) AS suf FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN p END AS prefix_chars, CASE WHEN form <> 'plain' THEN q - p END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM o
"""
