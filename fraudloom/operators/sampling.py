"""Seeded sampling, splits and set operations.

A fixed random sequence cannot be reproduced across engines, so the contract is kept
instead: size, quotas, disjointness, and the same rows for the same seed.  The sort key
is a seeded hash of the id.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .durable import cut
from .ordered import row_numbers

L = F.lit


def seeded(seed: int, *cols) -> Column:
    return F.xxhash64(*cols, L(seed))


def red_team_unused(pool: DataFrame, used: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n random entries not used before; from the whole pool only when every entry is used."""
    flag = used.select("id").distinct().withColumn("__used", L(1))
    tagged = pool.join(flag, "id", "left").withColumn("__used", F.coalesce("__used", L(0)))
    fresh = tagged.filter("__used = 0").agg(F.count(L(1)).alias("__fresh"))
    usable = tagged.crossJoin(F.broadcast(fresh)).filter((F.col("__used") == 0) | (F.col("__fresh") == 0))  # one row
    return usable.orderBy(seeded(seed, "id"), "id").limit(n).drop("__used", "__fresh")


def round_robin(entries: DataFrame, group: str, n: int, seed: int = 0) -> DataFrame:
    """One per group in turn, random inside a group.  Only the first n of a group can be chosen."""
    w = Window.partitionBy(group).orderBy(seeded(seed, "id"), "id")
    return entries.withColumn("turn", F.row_number().over(w)).filter(F.col("turn") <= n).orderBy("turn", group).limit(n)


def pick_disjoint(entries: DataFrame, identity: str, taken: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n random entries of identities not taken, topped up from taken ones when short."""
    flag = taken.select(identity).distinct().withColumn("__taken", L(1))
    return entries.join(flag, identity, "left").withColumn("taken", F.coalesce("__taken", L(0))).drop("__taken").orderBy("taken", seeded(seed, "id"), "id").limit(n)


def balance(clips: DataFrame, per_class: int, seed: int = 0) -> DataFrame:
    """Reals capped at per_class; each fake method at max(1, per_class div methods)."""
    methods = clips.filter(F.col("label") == "fake").agg(F.countDistinct("method").alias("m"))
    cap = F.when(F.col("label") == "real", L(per_class)).otherwise(F.greatest(L(1), F.floor(L(per_class) / F.col("m"))))
    w = Window.partitionBy("label", "method").orderBy(seeded(seed, "id"), "id")
    k = F.when(F.col("label") == "real", L("")).otherwise(F.col("method"))
    ranked = clips.withColumn("method", k).withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= per_class)
    return ranked.crossJoin(F.broadcast(methods)).filter(F.col("rn") <= cap).drop("m", "rn")  # one row


def cap_imbalance(df: DataFrame, label: str = "y", ratio: int = 4, seed: int = 0) -> DataFrame:
    """Every positive, and at most ratio times as many negatives."""
    keyed = df.withColumn("__k", seeded(seed, "id"))
    ranked = row_numbers(keyed.filter(F.col(label) == 0), [], "__k", ["id"], "__rn")
    quota = df.agg((F.count(F.when(F.col(label) == 1, 1)) * ratio).alias("__q"))
    kept = ranked.crossJoin(F.broadcast(quota)).filter(F.col("__rn") <= F.col("__q"))  # one row
    return df.filter(F.col(label) == 1).unionByName(kept.select(*df.columns))


def spaced_subsample(pairs: DataFrame, order: str, n: int) -> DataFrame:
    """n evenly spaced rows in `order`, ends included; everything when there are no more than n."""
    numbered = row_numbers(pairs, [], order, [], "__rn", "__total")
    i, total = F.col("__rn") - 1, F.col("__total")
    # row i is chosen when some slot k has floor(k * (total-1) / (n-1)) = i
    k = F.ceil(i * (n - 1) / F.greatest(total - 1, L(1)))
    chosen = F.floor(k * (total - 1) / (n - 1)) == i if n > 1 else i == 0
    return numbered.filter((total <= n) | chosen).drop("__rn", "__total")


def one_per_identity(photos: DataFrame, identity: str, name: str) -> DataFrame:
    """First photo per identity in name order, as one aggregation."""
    rest = [c for c in photos.columns if c != identity]
    return photos.groupBy(identity).agg(F.min_by(F.struct(*rest), F.col(name)).alias("e")).select(identity, "e.*")


def paired_keys(rows: DataFrame, key: str, split: str, n_splits: int) -> DataFrame:
    """Keys with a flag: present in every split or not."""
    return rows.groupBy(key).agg(F.countDistinct(split).alias("splits")).withColumn("paired", F.col("splits") == n_splits)


def report_availability(expected: DataFrame, found: DataFrame) -> DataFrame:
    have = found.select("name").distinct().withColumn("available", L(True))
    return expected.join(have, "name", "left").fillna({"available": False})


def union_populations(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


# --- splits --------------------------------------------------------------------
def identity_split(manifest: DataFrame, index: str, total: int, frac: float = 0.35) -> DataFrame:
    """The last `frac` of identity indexes are held out."""
    cut = int(total * (1 - frac))
    return manifest.withColumn("split", F.when(F.col(index) >= cut, "test").otherwise("train"))


def subject_split(df: DataFrame, subject: str = "subject", label: str = "label", frac: float = 0.3, seed: int = 0) -> DataFrame:
    """Holds out a share of the subjects of each label, at least one, never splitting a subject."""
    people = df.groupBy(label, subject).agg(F.count(L(1)).alias("__c")).withColumn("__k", seeded(seed, subject))
    ranked = row_numbers(people.select(label, subject, "__k"), [label], "__k", [subject], "__rn", "__n")
    held = ranked.filter(F.col("__rn") <= F.greatest(L(1), F.rint(F.col("__n") * frac))).select(F.col(subject)).distinct().withColumn("held_out", L(True))
    return df.join(held, subject, "left").fillna({"held_out": False})


def stratified_folds(df: DataFrame, k: int, label: str = "y", seed: int = 0) -> DataFrame:
    """Folds of equal size inside each class."""
    numbered = row_numbers(df.withColumn("__k", seeded(seed, "id")), [label], "__k", ["id"], "__rn")
    return numbered.withColumn("fold", F.pmod(F.col("__rn") - 1, L(k)).cast("int")).drop("__rn", "__k")


def group_folds(df: DataFrame, k: int, group: str, seed: int = 0) -> DataFrame:
    """Identity-disjoint folds: groups dealt out by size, back and forth, largest first."""
    sizes = df.groupBy(group).agg(F.count(L(1)).alias("n")).withColumn("__k", -F.col("n").cast("double"))
    ranked = row_numbers(sizes, [], "__k", [group], "__rn")
    lap, at = F.floor((F.col("__rn") - 1) / k), F.pmod(F.col("__rn") - 1, L(k))
    fold = F.when(lap % 2 == 0, at).otherwise(k - 1 - at).cast("int")
    return df.join(ranked.select(group, fold.alias("fold")), group)


def leave_one_group_out(df: DataFrame, group: str, most: int = 1000) -> DataFrame:
    """The plan of the protocol: (group, code, n_train, n_test), one row for each value of a low-cardinality column.

    Fits that leave out `code` are fitted side by side (see `newton`), so no training set is
    copied.  Rows without a value are always trained on.  More than `most` values are refused.
    """
    per = cut(df.groupBy(group).agg(F.count(L(1)).alias("n_test")))
    if per.count() > most:
        raise ValueError(f"{group} has more than {most:,} values: one model per value is not a protocol for it")
    total = per.agg(F.sum("n_test").alias("__all"))
    code = F.row_number().over(Window.orderBy(group)) - 1  # at most `most` rows
    return per.filter(F.col(group).isNotNull()).withColumn("code", code).crossJoin(F.broadcast(total)).select(group, "code", (F.col("__all") - F.col("n_test")).alias("n_train"), "n_test")  # one row


def score_identity_join(scores: DataFrame, manifest: DataFrame, folds: int = 5) -> DataFrame:
    """scores (id, split, ...) with identity and capture from the manifest (id, identity, capture), and a fold for training rows.

    Folds are identity-disjoint if every training row has an identity and there are more
    identities than folds; otherwise they are row-wise, and `fold_kind` says so, since rates
    measured on them are optimistic.  Ids that the manifest holds twice take its lowest entry.
    """
    known = manifest.filter(F.col("id").isNotNull()).groupBy("id").agg(F.min(F.struct("identity", "capture")).alias("m")).select("id", "m.identity", "m.capture")
    joined = cut(scores.drop("identity", "capture").join(known, "id", "left"))
    train = joined.filter("split = 'train'")
    missing, people = train.agg(F.count(F.when(F.col("identity").isNull(), 1)), F.countDistinct("identity")).first()
    grouped = missing == 0 and people > folds
    dealt = group_folds(train, folds, "identity") if grouped else stratified_folds(train, folds)
    kind = L("identity" if grouped else "row")
    rest = joined.filter("split IS NULL OR split <> 'train'").withColumn("fold", L(None).cast("int"))
    return dealt.select(*joined.columns, "fold").unionByName(rest).withColumn("fold_kind", kind)


# --- sessionising research corpora -------------------------------------------------
def cmu_sessionise(rows: DataFrame, keys_per_row: int, keys: int = 110) -> DataFrame:
    """Groups repetitions of a fixed phrase into form-sized sessions; the last partial one is dropped."""
    per = -(-keys // keys_per_row)
    numbered = row_numbers(rows, ["subject"], "rep", [], "rn", "total")
    s = F.floor((F.col("rn") - 1) / per)
    return numbered.withColumn("session", s).filter((s + 1) * per <= F.col("total")).drop("rn", "total")


def chunk_starts(moves: DataFrame, keys: int) -> DataFrame:
    """subject, chunk, have, session, complete from moves (subject, chunk from 0, m): what is open and how many
    sessions are closed when the chunk begins, and how many the subject closes in all.

    m[i] = (have, closed) after the chunk if i keys are open before it.
    """
    then = lambda first, second: F.transform(first, lambda x: F.struct(F.get(second, x["have"].cast("int"))["have"].alias("have"), (x["closed"] + F.get(second, x["have"].cast("int"))["closed"]).alias("closed")))
    levels = [cut(moves)]
    while levels[-1].filter("chunk > 0").limit(1).count():
        half = levels[-1].withColumn("up", F.floor(F.col("chunk") / 2))
        left = half.filter("chunk % 2 = 0").select("subject", "up", F.col("m").alias("a"))
        right = half.filter("chunk % 2 = 1").select("subject", "up", F.col("m").alias("b"))
        both = left.join(right, ["subject", "up"], "left")  # the last chunk of an odd level has no partner
        levels.append(cut(both.select("subject", F.col("up").alias("chunk"), F.when(F.col("b").isNull(), F.col("a")).otherwise(then(F.col("a"), F.col("b"))).alias("m"))))
    zero = L(0).cast("bigint")
    total = levels[-1].select("subject", F.get("m", 0)["closed"].alias("complete"))
    at = levels[-1].select("subject", "chunk", zero.alias("have"), zero.alias("session"))
    for level in reversed(levels[:-1]):
        lead = at.withColumnRenamed("chunk", "up")
        half = level.withColumn("up", F.floor(F.col("chunk") / 2))
        first = half.filter("chunk % 2 = 0").join(lead, ["subject", "up"])
        move = F.get("m", F.col("have").cast("int"))
        after = first.select("subject", (F.col("chunk") + 1).alias("chunk"), move["have"].alias("have"), (F.col("session") + move["closed"]).alias("session"))
        odd = half.filter("chunk % 2 = 1").select("subject", "chunk").join(after, ["subject", "chunk"])
        at = cut(first.select("subject", "chunk", "have", "session").unionByName(odd))
    return at.join(total, "subject")


def aalto_sessionise(sections: DataFrame, keys: int = 110, chunk_rows: int = 4096) -> DataFrame:
    """Whole sections in text order accumulate until a session has `keys` keys; the tail is dropped.

    sections: subject, section, n_keys (already aggregated from key events).

    The running total restarts after every session, so a window sum cannot do it.  What a
    run of sections does depends only on how many keys are open when it starts (0 to
    keys - 1): a chunk is a function from that number to (keys open, sessions closed) after
    it.  Functions of neighbouring chunks are composed pairwise, level by level, up to one per
    subject; then the true starts are handed down the same levels, and each chunk is walked
    again from its own.  No task holds more than one chunk of sections or two functions, and
    the levels have half as many rows each time.
    """
    ranked = sections.select("subject", "section", F.col("n_keys").cast("bigint").alias("n_keys"), F.conv(F.hex(F.substring(F.encode(F.rpad("section", 4, "\x00"), "UTF-8"), 1, 4)), 16, 10).cast("double").alias("__p"))
    numbered = row_numbers(ranked, ["subject"], "__p", ["section"], "__rn")
    chunked = numbered.withColumn("chunk", F.floor((F.col("__rn") - 1) / chunk_rows))
    walk = F.array_sort(F.collect_list(F.struct("section", "n_keys")))  # at most chunk_rows entries
    chunks = cut(chunked.groupBy("subject", "chunk").agg(walk.alias("s")))

    def advance(open_keys):
        """(keys open, sessions closed) after the chunk, from a given start."""
        begin = F.struct(open_keys.cast("bigint").alias("have"), L(0).cast("bigint").alias("closed"))

        def step(acc, x):
            total = acc["have"] + x["n_keys"]
            done = total >= keys
            return F.struct(F.when(done, L(0)).otherwise(total).cast("bigint").alias("have"), (acc["closed"] + done.cast("bigint")).alias("closed"))

        return F.aggregate("s", begin, step)

    moves = chunks.select("subject", "chunk", F.transform(F.sequence(L(0), L(keys - 1)), advance).alias("m"))
    starts = chunk_starts(moves, keys)
    begin = F.struct(F.col("have").alias("have"), F.col("session").alias("session"), F.array().cast("array<struct<section:string,session:bigint>>").alias("out"))

    def label(acc, x):
        total = acc["have"] + x["n_keys"]
        done = total >= keys
        here = F.struct(x["section"].alias("section"), acc["session"].alias("session"))
        return F.struct(F.when(done, L(0)).otherwise(total).cast("bigint").alias("have"), (acc["session"] + done.cast("bigint")).alias("session"), F.array_append(acc["out"], here).alias("out"))

    labelled = chunks.join(starts, ["subject", "chunk"]).select("subject", "complete", F.explode(F.aggregate("s", begin, label)["out"]).alias("e"))
    return labelled.filter(F.col("e.session") < F.col("complete")).select("subject", "e.section", F.col("e.session").cast("int").alias("session"))
