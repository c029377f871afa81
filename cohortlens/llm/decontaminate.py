"""Benchmark decontamination by templates, in DataFrame functions alone.

A text is split into tokens, and each token into a kind: number, unit, name or
word. Windows of five tokens are hashed with placeholders for numbers and
units, once with names as placeholders and once as lower-cased words, and
joined with those of the benchmark. A document that holds some of an item's
windows is a candidate. Matched windows whose places lie near one diagonal are
one occurrence of the item. Along it the item's tokens are compared with the
document's: enough of them must be covered, and what stands in their slots must
keep to one replacement a value, as in a re-parameterised question.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.session import staged, staging

NUMBER, NAME, UNIT = "0num", "0name", "0unit"

#: Units, replaced only where they follow a number.
UNITS = (
    "percent", "kg", "kilograms", "g", "grams", "mg", "lb", "pounds", "km", "kilometers", "kilometres", "m", "meters", "metres",
    "cm", "mm", "mile", "miles", "mph", "ft", "feet", "inch", "inches", "s", "second", "seconds", "min", "minute", "minutes",
    "h", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years", "l", "liters", "litres", "ml",
    "dollar", "dollars", "euro", "euros", "cent", "cents", "degrees",
)

_TOKEN = r"([0-9]+(?:[.,:/][0-9]+)*|[\p{L}\p{N}&&[^0-9]]+)"


@dataclass(frozen=True)
class LeakSettings:
    """A document leaks an item if one occurrence covers ``percent`` of the item's
    tokens and at least ``consistent`` percent of its slots keep to one replacement
    a value. Candidates hold ``seeds`` percent of the item's windows. The
    benchmark's windows are broadcast up to ``broadcast_rows`` rows (some 40
    bytes each) and joined by a shuffle beyond.
    """

    window: int = 5
    percent: int = 80
    consistent: int = 80
    seeds: int = 10
    broadcast_rows: int = 500_000


def tokens(text: Column) -> Column:
    """Words and whole numbers as they stand, empty without text."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_TOKEN), F.lit(1))


def _number(token: Column) -> Column:
    return token < ":"


def _name(token: Column) -> Column:
    """Begins with a capital and has a lower-case letter."""
    first = F.substring(token, 1, 1)
    return (first != F.lower(first)) & (token != F.upper(token))


def _hash_of(placeholder: str) -> Column:
    return F.xxhash64(F.lit(placeholder))


def word_hashes(raw: str) -> Column:
    """Hashes of the tokens in a column: lower case, placeholders for numbers and units."""

    def form(token: Column, at: Column) -> Column:
        unit = (at > 0) & _number(F.get(F.col(raw), at - 1)) & F.lower(token).isin(*UNITS)
        return F.when(_number(token), _hash_of(NUMBER)).when(unit, _hash_of(UNIT)).otherwise(F.xxhash64(F.lower(token)))

    return F.transform(raw, form)


def name_hashes(raw: str, words: str) -> Column:
    """The hashes in ``words`` with a placeholder for names as well."""
    return F.zip_with(raw, words, lambda token, h: F.when(_name(token) & (h != _hash_of(UNIT)), _hash_of(NAME)).otherwise(h))


def window_column(parts: str, size: int) -> Column:
    """Hashes of runs of ``size`` tokens by position, none of a shorter text."""
    count = F.size(parts)
    runs = F.col(parts)
    for k in range(1, size):
        later = F.slice(parts, F.lit(k + 1), F.greatest(count - k, F.lit(0)))
        runs = F.zip_with(runs, later, lambda a, b: F.xxhash64(a, b))
    return F.when(count >= size, F.slice(runs, F.lit(1), count - (size - 1))).otherwise(F.array().cast("array<bigint>"))


def _templated(frame: DataFrame, *ids: str) -> DataFrame:
    """raw tokens, and their hashes as ``words`` and, with placeholders for names, as ``names``."""
    cut = frame.select(*ids, tokens(F.col("text")).alias("raw"))
    hashed = cut.select(*ids, "raw", word_hashes("raw").alias("words"))
    return hashed.select(*ids, "raw", "words", name_hashes("raw", "words").alias("names"))


def _once(frame: DataFrame, name: str, value: Column) -> DataFrame:
    """``frame`` with ``value`` worked out once a row.

    A generator of one element keeps the optimiser from moving the expression
    into lambdas and filters that use it, where it would be repeated.
    """
    return frame.select(*[c for c in frame.columns if c != name], F.explode(F.array(value)).alias(name))


def _items(benchmark: DataFrame, settings: LeakSettings) -> DataFrame:
    """item, item_id, n, size (of its windows), raw, words, names."""
    named = benchmark.select("item_id", F.col("text").cast("string").alias("text")).withColumn("item", F.xxhash64("item_id", "text"))
    cut = _templated(named.dropDuplicates(["item"]), "item", "item_id").withColumn("n", F.size("raw")).filter("n > 0")
    return staged(cut.withColumn("size", F.least("n", F.lit(settings.window))), "items")


def _small(frame: DataFrame, settings: LeakSettings) -> DataFrame:
    """Broadcast where a count proves it small; by a shuffle otherwise."""
    return F.broadcast(frame) if frame.count() <= settings.broadcast_rows else frame


def _windows(frame: DataFrame, ids: list[str], sizes: list[int]) -> DataFrame:
    """One row per window: ids, at, hash; the form with names only where it is another."""
    hashed = frame.select(*ids, *[window_column(kind, k).alias(f"{kind}{k}") for k in sizes for kind in ("words", "names")])

    def placed(h: Column, at: Column) -> Column:
        return F.struct(at.alias("at"), h.alias("hash"))

    def other(words: str) -> Callable[[Column, Column], Column]:
        return lambda h, at: F.when(h != F.get(words, at), placed(h, at))

    parts = []
    for k in sizes:
        parts += [F.transform(f"words{k}", placed), F.array_compact(F.transform(f"names{k}", other(f"words{k}")))]
    return hashed.select(*ids, F.explode(F.concat(*parts)).alias("w")).select(*ids, "w.*")


def leaks(documents: DataFrame, benchmark: DataFrame, settings: LeakSettings | None = None) -> DataFrame:
    """One row per document and leaked item.

    doc_id, text_hash, item_id, n_windows (of the item), n_matched, n_slots
    (compared), n_changed (slots with another value), the last two of the
    occurrence that covers most. ``text_hash`` and doc_id tell documents apart;
    equal rows are one.

    Null or empty texts and items leak nothing. Null ids are kept as they are.
    An item shorter than a window has windows of its own size and leaks by the
    same words and values. Items with the same id and text count once. Other
    columns are ignored.
    """
    settings = settings or LeakSettings()
    items = _items(benchmark, settings)
    sizes = sorted({settings.window, *[r["size"] for r in items.select("size").distinct().limit(settings.window).collect()]})
    keyed = documents.select(F.col("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    placed = staged(_item_windows(items, sizes), "item-windows")
    texts = _templated(keyed, "doc_id", "text_hash")
    hashed = texts.select("doc_id", "text_hash", *[window_column(kind, k).alias(f"{kind}{k}") for k in sizes for kind in ("words", "names")])
    every = F.array_distinct(F.concat(*[f"{kind}{k}" for k in sizes for kind in ("words", "names")]))
    matched = hashed.select("doc_id", "text_hash", F.explode(every).alias("hash")).join(_small(placed, settings), "hash")
    candidates = staged(
        matched.groupBy("doc_id", "text_hash", "item")
        .agg(F.max("n_windows").alias("n_windows"), F.count_distinct("at").alias("n_matched"))
        .filter(100 * F.col("n_matched") >= settings.seeds * F.col("n_windows")),
        "leak-candidates",
    )
    return _covered(keyed, items, placed, candidates, sizes, settings)


def _item_windows(items: DataFrame, sizes: list[int]) -> DataFrame:
    """item, n_windows, at, hash of the windows with a plain word, or of all if none has one."""
    found = None
    for k in sizes:
        rows = _windows(items.filter(F.col("size") == k), ["item", "names"], [k])
        plain = F.exists(F.slice("names", F.col("at") + 1, k), lambda w: ~w.isin(_hash_of(NUMBER), _hash_of(NAME), _hash_of(UNIT)))
        rows = rows.select("item", "at", "hash", plain.alias("plain"))
        found = rows if found is None else found.unionByName(rows)
    count = found.groupBy("item").agg(F.max("plain").alias("any"), F.count_distinct("at").alias("n_windows"))
    return found.join(count, "item").filter("plain OR NOT any").select("item", "n_windows", "at", "hash").distinct()


def _covered(keyed: DataFrame, items: DataFrame, placed: DataFrame, candidates: DataFrame, sizes: list[int], settings: LeakSettings) -> DataFrame:
    """Candidates with an occurrence that is covered and consistent."""
    docs = candidates.select("doc_id", "text_hash").distinct()
    same = F.col("k.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("k.text_hash") == F.col("c.text_hash"))
    chosen = keyed.alias("k").join(docs.alias("c"), same, "left_semi").dropDuplicates(["doc_id", "text_hash"])
    # few rows, but whole texts and much work: as many tasks as a shuffle has
    tasks = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = chosen.withColumn("doc", F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text_hash")).repartition(tasks, "doc")
    texts = staged(_templated(spread, "doc"), "leak-texts")
    pairs = candidates.withColumn("doc", F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text_hash"))
    wanted = pairs.select("doc", "item").join(placed.select("item", "at", "hash"), "item")
    hits = wanted.join(_windows(texts, ["doc"], sizes).withColumnRenamed("at", "doc_at"), ["doc", "hash"])
    shift = hits.join(items.select("item", "n"), "item").select("doc", "item", "n", (F.col("doc_at") - F.col("at")).alias("shift")).distinct()
    # an occurrence's diagonals differ by a fifth of the item at most, so one of two overlapping bands has them all
    reach = F.greatest(F.lit(1), F.ceil(F.col("n") / 5).cast("int"))
    band = F.floor(F.col("shift") / reach).cast("int")
    bands = shift.withColumn("band", F.explode(F.array(band - 1, band))).groupBy("doc", "item", "band").agg(F.collect_set("shift").alias("shifts"))
    both = bands.join(items.select("item", "n", "size", F.col("raw").alias("i_raw"), F.col("words").alias("i_words"), F.col("names").alias("i_names")), "item")
    both = both.join(texts.select("doc", F.col("raw").alias("d_raw"), F.col("words").alias("d_words"), F.col("names").alias("d_names")), "doc")

    name = _hash_of(NAME)

    def met(p: Column, q: Column) -> Column:
        names = (F.get("i_names", p) == name) & (F.get("d_names", q) == name)
        return F.when(q >= 0, F.coalesce((F.get("i_words", p) == F.get("d_words", q)) | names, F.lit(False))).otherwise(False)

    def ran(at: Column, p: Column) -> Column:
        """Token p is matched, in a run of three (or the whole of a shorter item)."""

        def x(k: int) -> Column:
            return F.when(p + k >= 0, F.coalesce(F.get(at, p + k), F.lit(False))).otherwise(False) if k else F.get(at, p)

        return x(0) & ((F.col("n") < 3) | (x(-2) & x(-1)) | (x(-1) & x(1)) | (x(1) & x(2)))

    spot = F.sequence(F.lit(0), F.col("n") - 1)
    matched = F.transform("shifts", lambda s: F.struct(s.alias("s"), F.transform(spot, lambda p: met(p, p + s)).alias("met")))
    both = _once(both, "matched", matched)
    runs = F.transform("matched", lambda m: F.struct(F.filter(spot, lambda p: ran(m["met"], p)).alias("at"), m["s"].alias("s")))
    longest_first = F.array_sort(F.transform(runs, lambda r: F.struct((-F.size(r["at"])).alias("k"), r["s"].alias("s"), r["at"].alias("at"))))
    ordered = _once(both.drop("shifts"), "runs", longest_first).drop("matched")
    # every item token at the diagonal of the longest match that has it
    place = F.transform(spot, lambda p: F.struct(p.alias("p"), (p + F.get(F.filter("runs", lambda r: F.array_contains(r["at"], p)), F.lit(0))["s"]).alias("q")))
    found = _once(ordered, "at", F.filter(place, lambda x: x["q"].isNotNull()))
    found = found.filter(100 * F.size("at") >= settings.percent * F.col("n"))
    slots = F.transform(
        F.filter("at", lambda x: F.get("i_words", x["p"]).isin(_hash_of(NUMBER), _hash_of(UNIT)) | (F.get("i_names", x["p"]) == name)),
        lambda x: F.struct(F.lower(F.get("i_raw", x["p"])).alias("old"), F.lower(F.get("d_raw", x["q"])).alias("new")),
    )
    kept = _once(found, "slots", slots).select("doc", "item", "n", "size", F.size("at").alias("n_covered"), "slots")
    olds = F.array_distinct(F.transform("slots", lambda x: x["old"]))
    most = F.transform(
        olds,
        lambda o: F.array_max(F.transform(F.filter("slots", lambda x: x["old"] == o), lambda y: F.size(F.filter("slots", lambda z: z == y)))),
    )
    judged = kept.select(
        "doc", "item", "n", "n_covered", F.size("slots").alias("n_slots"),
        F.size(F.filter("slots", lambda x: x["old"] != x["new"])).alias("n_changed"),
        F.aggregate(most, F.lit(0), lambda a, b: a + b).alias("main"),
    )
    good = judged.filter(100 * F.col("main") >= settings.consistent * F.col("n_slots")).filter(
        (F.col("n") >= settings.window) | ((F.col("n_changed") == 0) & (F.col("n_covered") == F.col("n")))
    )
    best = good.groupBy("doc", "item").agg(F.max_by(F.struct("n_slots", "n_changed"), F.struct("n_covered", -F.col("n_changed"))).alias("best"))
    return pairs.join(best, ["doc", "item"]).join(items.select("item", "item_id"), "item").select(
        "doc_id", "text_hash", "item_id", "n_windows", "n_matched", "best.n_slots", "best.n_changed"
    )


def decontaminated(documents: DataFrame, benchmark: DataFrame, settings: LeakSettings | None = None) -> DataFrame:
    """The documents that leak no item, all columns as they are."""
    with staging(documents.sparkSession):
        leaked = leaks(documents, benchmark, settings).select("doc_id", "text_hash").distinct()
        found = staged(leaked, "leaks", outlast=True).alias("f")
    held = documents.select(F.struct("*").alias("d")).alias("h")
    same = F.col("h.d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.xxhash64(F.col("h.d.text").cast("string")) == F.col("f.text_hash"))
    return held.join(found, same, "left_anti").select("d.*")
