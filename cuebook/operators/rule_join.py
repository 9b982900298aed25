"""Rules held as a table, evaluated by a join: no rule passes the driver, whatever their number.

A rules table (``RULES_TABLE_SCHEMA``) may hold millions of rules, each about few rows of the data. So the rules are
inverted: a rule lies under *keys* and a row looks up the keys of its values.

* An "and" rule lies under one criterion, the one likely to let fewest rows pass: ``eq`` or ``in`` on text or numbers (one key
  for each value), else the bounds on one numeric column taken together. An "or" rule lies under each of its criteria.
* A bounded range covers *places* of its column: the cut points and the gaps between them. Cut points are approximate quantiles
  of the data, its least and greatest number, and the bounds that the rules set between these two: all of them up to
  ``BOUND_CUTS`` for each of ``BUCKETS``, quantiles beyond. So neither many rows nor many bounds share a gap, a value that many rows have is
  a place of its own, and a range outside the data has no place.
* Places are the leaves of a tree with ``FAN`` branches. A rule lies under the fewest nodes that make up its places, at most
  2 x ``FAN`` a level, and a row has one key for each level where its node holds rules. A node with many rules deals them into
  chunks of about ``CHUNK``, each a key, so that no task has all pairs of a node. Only pairs in a gap that a rule covers in part can miss its range.
* A bitmap of hashed value keys, ``KEY_WORDS`` words a column, tells which rows' keys no rule has; these rows are not shuffled.
* Keys meet in a plain equi-join, whose hot keys Spark splits; all criteria of a rule are then checked on the candidate pairs, on the
  typed columns of the row. Of an "or" rule only its first passing criterion gives the signal, so no pair comes twice and nothing is deduplicated.

A rule without such a criterion ("or" rules: with one that is none) has to see every row. These rules are
collected, at most ``MOST_SCANNED`` or it is an error, and run as a scan by ``rules.evaluate``.

Values compare as in ``functions/predicates.py``; whole numbers exactly, others as doubles. A rule on a missing column,
without criteria or under a repeated ``rule_id`` gives what its criteria give; run ``validate_rules`` first.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.predicates import FRACTIONAL, INTEGRAL, decrease_ratio, python_float, python_text, qcol
from ..functions.scores import confidence_band, normalise_score
from ..model import OPERATORS
from ..session import checkpoint_dir
from .rule_index import const_array
from .rules import empty_signals, evaluate, rules_from_table
from .signals import NOTE

BUCKETS = 256
BOUND_CUTS = 16
FAN = 16
CHUNK = 256
KEY_WORDS = 1 << 14
MOST_SCANNED = 1000
_BOUNDS = ("lt", "lte", "gt", "gte")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, computed once however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _kind(dtype: T.DataType) -> str:
    """How values of a column compare: as whole numbers, as doubles, as text, or with nothing but null."""
    kinds = {"whole": (*INTEGRAL, T.BooleanType), "real": (*FRACTIONAL, T.DecimalType), "text": (T.StringType,)}
    return next((k for k, of in kinds.items() if isinstance(dtype, of)), "other")


def _values(value: Column) -> Column:
    """A criterion's JSON value as an array of (kind, l, n, s, t): a list's elements, else the value itself."""
    def one(v: Column) -> Column:
        return _let(F.schema_of_variant(v), lambda kind: of_kind(v, kind))

    def of_kind(v: Column, kind: Column) -> Column:
        is_bool, number = kind == "BOOLEAN", kind.rlike("^(BIGINT|DOUBLE|DECIMAL.*|FLOAT|BOOLEAN)$")
        n = F.when(is_bool, F.try_variant_get(v, "$", "boolean").cast("int").cast("double")).when(number, F.try_variant_get(v, "$", "double"))
        return _let(F.struct(kind.alias("kind"), n.alias("n"), F.try_variant_get(v, "$", "string").alias("text")), lambda x: of_number(v, x))

    def of_number(v: Column, x: Column) -> Column:
        kind, n, text = x["kind"], x["n"], x["text"]
        is_text, is_bool = kind == "STRING", kind == "BOOLEAN"
        number = kind.rlike("^(BIGINT|DOUBLE|DECIMAL.*|FLOAT)$") | is_bool
        whole = F.when(is_bool, F.try_variant_get(v, "$", "boolean").cast("int").cast("bigint")) \
            .when(kind == "BIGINT", F.try_variant_get(v, "$", "bigint"))
        # A decimal or double that is whole compares with whole numbers too.
        whole = F.when(number, F.coalesce(whole, F.when((n == F.floor(n)) & (F.abs(n) < 2.0**53), n.cast("bigint"))))
        # A decimal loses its trailing zero in a variant.
        shown = F.when(is_bool, F.initcap(text)).when(kind == "VOID", F.lit("None")) \
            .when(number & (kind != "BIGINT") & ~text.contains("."), F.concat(text, F.lit(".0"))).otherwise(text)
        return F.struct(F.when(kind == "VOID", F.lit("null")).when(is_text, F.lit("text")).when(is_bool, F.lit("bool")).when(number, F.lit("number"))
                        .otherwise(F.lit("other")).alias("kind"), whole.alias("l"), n.alias("n"), F.when(is_text, text).alias("s"), shown.alias("t"))

    listed = F.from_json(value, "array<variant>")
    return F.transform(F.when(F.ltrim(value).startswith("["), listed).otherwise(F.array(F.try_parse_json(F.coalesce(value, F.lit("null"))))), one)


def _criteria(rules: DataFrame) -> DataFrame:
    """``rules`` with ``criteria`` parsed: (field, op, base, list, values, evidence)."""
    def one(c: Column) -> Column:
        return _let(_values(c["value"]), lambda values: parsed(c, values))

    def parsed(c: Column, values: Column) -> Column:
        listed = F.ltrim(c["value"]).startswith("[")
        quoted = F.transform(values, lambda v: F.when(v["kind"] == "text", F.concat(F.lit("'"), v["s"], F.lit("'"))).otherwise(v["t"]))
        shown = F.when(listed, F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))).when(F.get(values, F.lit(0))["kind"] == "number", F.trim(c["value"])).otherwise(F.get(values, F.lit(0))["t"])
        return F.struct(c["field"].alias("field"), c["operator"].alias("op"), c["baseline_field"].alias("base"), F.coalesce(listed, F.lit(False)).alias("listed"),
                        values.alias("values"), F.concat_ws(" ", c["field"], c["operator"], F.coalesce(shown, F.lit("None"))).alias("evidence"))

    return rules.withColumn("criteria", F.transform(F.coalesce("criteria", F.array().cast(rules.schema["criteria"].dataType)), one))


def _first(c: Column) -> Column:
    return F.get(c["values"], F.lit(0))


def _check(c: Column, types: dict[str, T.DataType]) -> Column:
    """A criterion as the check of a pair reads it: its column and operator as one code, its values as those columns compare them."""
    def among(names: list[str]) -> Column:
        return F.array_contains(F.array(*[F.lit(n) for n in names]).cast("array<string>"), c["field"])

    columns, kinds = list(types), {n: _kind(t) for n, t in types.items()}
    at, op = (F.array_position(F.array(*[F.lit(n) for n in names]).cast("array<string>"), c[part]).cast("int") for names, part in ((columns, "field"), (OPERATORS, "op")))
    base = F.array_position(F.array(*[F.lit(n) for n in columns]).cast("array<string>"), c["base"]).cast("int")
    # ``eq`` of a list and ``in`` of no list have no value.
    members = F.when(F.when(c["op"] == "in", c["listed"]).otherwise(c["op"].isin("eq", "ne") & ~c["listed"]), c["values"])
    numbers = F.filter(members, lambda v: v["kind"].isin("number", "bool"))
    number = F.when(_first(c)["kind"] == "number", _first(c)["n"])
    return F.struct(F.when((at > 0) & (op > 0), (at - 1) * len(OPERATORS) + op - 1).alias("code"), (base - 1).alias("base"),
                    F.when(c["op"] == "relative_decrease", number).when(c["op"].isin(*_BOUNDS) & ~c["listed"], number).alias("n"),
                    F.coalesce(F.exists(members, lambda v: v["kind"] == "null"), F.lit(False)).alias("null"),
                    F.when(among([n for n, k in kinds.items() if k == "whole"]), F.transform(F.filter(numbers, lambda v: v["l"].isNotNull()), lambda v: v["l"])).alias("whole"),
                    F.when(among([n for n, k in kinds.items() if k == "real"]), F.transform(numbers, lambda v: v["n"])).alias("real"),
                    F.when(among([n for n, k in kinds.items() if k == "text"]), F.transform(F.filter(members, lambda v: v["kind"] == "text"), lambda v: v["s"])).alias("text"),
                    F.when(c["op"] == "text_present", F.lower(_first(c)["t"])).alias("part"))


def _passes(c: Column, op: str, cell: Column, dtype: T.DataType, bases: list[tuple[int, Column]]) -> Column:
    """Whether a criterion of ``_check``, known to have operator ``op``, holds on a row's cell; null or false if not. ``bases``: for each baseline its column as code, and its number."""
    if op in ("eq", "ne", "in"):
        kind = _kind(dtype)
        x = {"whole": lambda: cell.cast("int").cast("bigint") if isinstance(dtype, T.BooleanType) else cell.cast("bigint"), "real": lambda: cell.cast("double"), "text": lambda: cell}
        same = F.coalesce(F.array_contains(c[kind], x[kind]()), F.lit(False)) if kind in x else F.lit(False)
        same = same & ~F.isnan(cell) if isinstance(dtype, FRACTIONAL) else same
        member = F.when(cell.isNull(), c["null"]).otherwise(same)
        return ~member if op == "ne" else member
    if op == "text_present":
        return F.lower(python_text(cell, dtype)).contains(c["part"])
    number = python_float(cell, dtype)
    if number is None:
        return F.lit(False)
    n, v = number[0], c["n"]
    if op == "relative_decrease":
        ratio = F.lit(None).cast("double")
        for code, base in bases:
            ratio = F.when(c["base"] == code, decrease_ratio(n, base)).otherwise(ratio)
        return ~F.isnan(ratio) & (ratio >= v)
    return {"lt": n < v, "lte": n <= v, "gt": n > v, "gte": n >= v}[op] & ~F.isnan(n)


def _holds(c: Column, asked: set[tuple[str, str, str | None]], cells: dict[str, Column], types: dict[str, T.DataType]) -> Column:
    """Whether a criterion of ``_check`` holds on a row; never null. ``asked``: the columns with operators and baselines that criteria have."""
    columns, found = list(types), F.lit(False)
    for field, op in sorted({(f, o) for f, o, _ in asked}):
        floats = [(columns.index(b), python_float(cells[b], types[b])) for f, o, b in sorted(asked, key=str) if (f, o) == (field, op) and b is not None]
        this = _passes(c, op, cells[field], types[field], [(i, x[0]) for i, x in floats if x])
        found = F.when(c["code"] == columns.index(field) * len(OPERATORS) + OPERATORS.index(op), this).otherwise(found)
    return F.coalesce(found, F.lit(False))


def _value_key(dtype: T.DataType) -> Callable[[Column], Column]:
    """The key of a rule's value on a column: whole numbers are their own, others have hashes; null for what equals no value of the column."""
    if isinstance(dtype, T.StringType):
        return lambda v: F.when(v["kind"] == "text", F.xxhash64(v["s"]))
    return lambda v: F.when(v["kind"].isin("number", "bool"), v["l"] if isinstance(dtype, INTEGRAL) else F.xxhash64(v["n"] + 0.0))


def _row_key(c: Column, dtype: T.DataType) -> Column:
    """The key of a row's value as ``_value_key`` has it."""
    if isinstance(dtype, INTEGRAL):
        return c.cast("bigint")
    return F.when(c.isNotNull(), F.xxhash64(c if isinstance(dtype, T.StringType) else c.cast("double") + 0.0))


def _cut_points(df: DataFrame, bounds: DataFrame, fields: list[str], buckets: int) -> dict[str, list[float]]:
    """Least, greatest and at most ``buckets`` - 1 quantiles of each numeric column, and the bounds (f, bound) between; none for a column without numbers."""
    if not fields:
        return {}
    number = {f: F.when(~F.isnan(qcol(f).cast("double")), qcol(f).cast("double")) for f in fields}
    row = df.agg(*[x for i, f in enumerate(fields) for x in (
        F.percentile_approx(number[f], const_array([k / buckets for k in range(1, buckets)], "double"), 4 * buckets).alias(f"q{i}") if buckets > 1 else F.lit(None).alias(f"q{i}"),
        F.min(number[f]).alias(f"a{i}"), F.max(number[f]).alias(f"z{i}"))]).first()
    cuts = {f: {row[f"a{i}"], row[f"z{i}"], *(row[f"q{i}"] or [])} for i, f in enumerate(fields) if row[f"a{i}"] is not None}
    inside = reduce(lambda a, b: a | b, [(F.col("f") == f) & F.col("bound").between(min(c), max(c)) for f, c in cuts.items()], F.lit(False))
    most = BOUND_CUTS * buckets
    for r in bounds.filter(inside).distinct().groupBy("f").agg(F.percentile_approx("bound", const_array([k / most for k in range(1, most + 1)], "double"), 4 * most).alias("q")).collect():
        cuts[r["f"]] |= set(r["q"])
    return {f: sorted(c) for f, c in cuts.items()}


def _place(n: Column, cuts: list[float]) -> Column:
    """Where ``n`` lies, by binary search: 2i + 1 is cut point i, 2i the gap below it."""
    steps = [1 << k for k in range(len(cuts).bit_length() - 1, -1, -1)]
    at = const_array(cuts, "double")
    above = F.aggregate(const_array(steps, "int"), F.lit(0), lambda found, step: F.when(F.get(at, found + step - 1) <= n, found + step).otherwise(found))
    return _let(above, lambda k: F.when(F.get(at, k - 1) == n, 2 * k - 1).otherwise(2 * k))


def _seated(rows: DataFrame, seats: list[tuple[str, str, list[float]]]) -> DataFrame:
    """``rows`` with ``_place`` of columns, given as (column, name, cut points); null for no number. A projection a step, so that each is computed once."""
    stay, names = rows.columns, [name for _, name, _ in seats]
    found = rows.select(*stay, *[F.lit(0).alias(name) for name in names])
    at = [const_array(cuts, "double") for _, _, cuts in seats]
    step = 1 << max((len(cuts) for _, _, cuts in seats), default=0).bit_length()
    while step > 1:
        step //= 2
        found = found.select(*stay, *[F.when(F.get(own, F.col(name) + (step - 1)) <= F.col(c).cast("double"), F.col(name) + step).otherwise(F.col(name)).alias(name)
                                      for own, (c, name, _) in zip(at, seats, strict=True)])
    return found.select(*stay, *[F.when(~F.isnan(F.col(c).cast("double")), F.when(F.get(own, F.col(name) - 1) == F.col(c).cast("double"), 2 * F.col(name) - 1).otherwise(2 * F.col(name))).alias(name)
                                 for own, (c, name, _) in zip(at, seats, strict=True)])


def _levels(cuts: list[float]) -> int:
    """Levels of the tree over the places, without the root."""
    places, levels = 2 * len(cuts) + 1, 1
    while places > FAN**levels:
        levels += 1
    return levels


def _nodes(first: Column, last: Column, levels: int) -> Column:
    """The fewest nodes (level, at) that make up the places from ``first`` to ``last``."""
    return _let(F.struct(first.alias("a"), last.alias("z")), lambda span: _tree_runs(span["a"], span["z"], levels))


def _tree_runs(first: Column, last: Column, levels: int) -> Column:
    def run(level: int, a: Column, z: Column) -> Column:
        return F.when(a <= z, F.transform(F.sequence(a, z), lambda i: F.struct(F.lit(level).alias("level"), i.cast("int").alias("at")))) \
            .otherwise(F.array().cast("array<struct<level:int,at:int>>"))

    def ends(level: int) -> tuple[Column, Column]:
        """The nodes of a level that lie within as a whole."""
        size = FAN**level
        return F.floor((first + size - 1) / size), F.floor((last + 1) / size) - 1

    parts = []
    for level in range(levels):
        (a, z), (up_a, up_z) = ends(level), ends(level + 1)
        if level == levels - 1:
            parts.append(run(level, a, z))
        else:
            parts += [run(level, a, F.when(up_a <= up_z, up_a * FAN - 1).otherwise(z)), run(level, F.when(up_a <= up_z, (up_z + 1) * FAN).otherwise(z + 1), z)]
    return F.concat(*parts)


def _key_bit(key: Column) -> tuple[Column, Column]:
    """Where a value key is in a bitmap of ``KEY_WORDS`` words: (word, bit)."""
    at = F.pmod(F.xxhash64(key), F.lit(64 * KEY_WORDS))
    return F.floor(at / 64).cast("int"), (at % 64).cast("int")


def _node_key(level: Column | int, at: Column) -> Column:
    return F.lit(level).cast("bigint") * (1 << 32) + at


def evaluate_table(df: DataFrame, rules: DataFrame, id_field: str, keep: list[str] | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Every rule of the table ``rules`` against every row of ``df``: the rows of ``rules.evaluate``."""
    keep = list(keep or [])
    types = {f.name: f.dataType for f in df.schema.fields}
    numeric = [n for n, t in types.items() if isinstance(t, INTEGRAL + FRACTIONAL)]
    texts = [n for n, t in types.items() if isinstance(t, T.StringType)]
    # Side by side, also where the rules come as one small file.
    parsed = _criteria(rules.repartition(max(df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "rule_id"))
    named = F.array(*[F.lit(n) for n in numeric]).cast("array<string>")
    equal = F.array(*[F.lit(n) for n in numeric + texts]).cast("array<string>")

    def rank(c: Column) -> Column:
        """0 a value key, 1 a range key, 2 none."""
        value = c["op"].isin("eq", "in") & F.array_contains(equal, c["field"]) & F.forall(c["values"], lambda v: v["kind"] != "null")
        bound = c["op"].isin(*_BOUNDS) & F.array_contains(named, c["field"]) & (_first(c)["kind"] == "number") & ~c["listed"]
        return F.when(value, 0).when(bound, 1).otherwise(2)

    ranked = parsed.withColumn("ranks", F.transform("criteria", rank))
    either = (F.coalesce("combination", F.lit("and")) == "or") & (F.size("criteria") > 1)
    # "and": the best criterion; "or": all of them.
    best = F.array_position("ranks", F.array_min("ranks")).cast("int") - 1
    ranked = ranked.withColumn("either", either).withColumn("under", F.when(either, F.sequence(F.lit(0), F.size("criteria") - 1)).otherwise(F.array(best))) \
        .withColumn("scanned", (F.size("criteria") == 0) | F.when(either, F.array_max("ranks") == 2).otherwise(F.array_min("ranks") == 2))
    ranked = ranked.withColumn("checks", F.transform("criteria", lambda c: _check(c, types))).withColumn("texts", F.transform("criteria", lambda c: c["evidence"]))
    # Parsed and ranked once: in one plan each use of the criteria would write the parsing out again.
    checkpoint_dir(df.sparkSession)
    ranked = ranked.checkpoint(eager=True)
    joined = ranked.filter("not scanned").withColumn("key_at", F.explode("under")) \
        .withColumn("key", F.get("criteria", F.col("key_at"))).withColumn("rank", F.get("ranks", F.col("key_at")))
    # The keyed columns are known to the driver, as many as ``df`` has at most; so are the fields with their operators.
    used = {(r[0], r[1]) for r in joined.select("key.field", "rank").distinct().collect()}
    ranged, valued = sorted(f for f, r in used if r == 1), sorted(f for f, r in used if r == 0)
    columns = F.array(*[F.lit(n) for n in types]).cast("array<string>")
    asked = {tuple(r) for r in ranked.filter("not scanned").select(F.explode("criteria").alias("c"))
             .select("c.field", "c.op", F.when((F.col("c.op") == "relative_decrease") & F.array_contains(columns, F.col("c.base")), F.col("c.base")))
             .filter(F.array_contains(columns, F.col("field")) & F.col("op").isin(*OPERATORS)).distinct().collect()}

    # Rules under their keys. Bounds on the key's column narrow the range together for "and" rules.
    field = F.col("key.field")
    mine = F.when(F.col("either"), F.array("key")).otherwise(F.col("criteria"))
    mine = F.filter(mine, lambda c: (F.col("rank") == 1) & (c["field"] == field) & c["op"].isin(*_BOUNDS) & (_first(c)["kind"] == "number") & ~c["listed"])
    low = F.array_max(F.transform(F.filter(mine, lambda c: c["op"].isin("gt", "gte")), lambda c: F.struct(_first(c)["n"].alias("n"), (c["op"] == "gt").alias("out"))))
    high = F.array_min(F.transform(F.filter(mine, lambda c: c["op"].isin("lt", "lte")), lambda c: F.struct(_first(c)["n"].alias("n"), (c["op"] == "lte").alias("on"))))
    bounded = joined.withColumn("low", low).withColumn("high", high)
    bounds = bounded.filter("rank = 1").select(field.alias("f"), F.explode(F.array("low.n", "high.n")).alias("bound"))
    cuts = _cut_points(df, bounds, ranged, buckets)
    none = F.array().cast("array<struct<level:int,at:int>>")
    covered = none
    for f, at in cuts.items():
        # The least and the greatest number of the data are cut points: places outside have no row.
        first, last = _place(F.col("low.n"), at), _place(F.col("high.n"), at)
        first = F.greatest(F.lit(1), F.when(F.col("low").isNull(), F.lit(1)).otherwise(first + (F.col("low.out") & (first % 2 == 1)).cast("int")))
        last = F.least(F.lit(2 * len(at) - 1), F.when(F.col("high").isNull(), F.lit(2 * len(at) - 1)).otherwise(last - (~F.col("high.on") & (last % 2 == 1)).cast("int")))
        covered = F.when(field == f, _nodes(first, last, _levels(at))).otherwise(covered)
    placed = bounded.filter("rank = 1").select(field.alias("f"), F.explode(covered).alias("node"))
    held = {(r["f"], r["level"], r["at"]): r["count"] for r in placed.groupBy("f", "node.level", "node.at").count().collect()} if cuts else {}
    # How many chunks the rules of a node are dealt into, by column and level; as many numbers as there are nodes at most.
    chunks: dict[tuple[str, int], list[int]] = {}
    for (f, level, at), n in held.items():
        row = chunks.setdefault((f, level), [0] * ((2 * len(cuts[f])) // FAN**level + 1))
        row[at] = -(-n // CHUNK)

    def node_keys(node: Column) -> Column:
        of = F.lit(None).cast("int")
        for (f, level), n in sorted(chunks.items()):
            of = F.when((field == f) & (node["level"] == level), F.get(const_array(n, "int"), node["at"])).otherwise(of)
        return F.struct(_node_key(node["level"], node["at"]).alias("key"), F.pmod(F.xxhash64("rule_id", "key_at"), of).cast("int").alias("chunk"))

    number = {f: i for i, f in enumerate(types)}  # of a column; its ranges count from len(types) on
    values = F.lit(None).cast("array<bigint>")
    for f in valued:
        values = F.when(field == f, F.transform("key.values", _value_key(types[f]))).otherwise(values)
    keys = F.when(F.col("rank") == 0, F.transform(F.array_distinct(F.filter(values, lambda k: k.isNotNull())), lambda k: F.struct(k.alias("key"), F.lit(0).alias("chunk"))))
    if chunks:
        keys = keys.otherwise(F.transform(covered, node_keys))
    # Which value keys rules may have, by column: a row's other keys meet no rule and are not shuffled.
    word, bit = _key_bit(F.col("key"))
    words = bounded.filter("rank = 0").select(field.alias("f"), F.explode(values).alias("key")).filter("key is not null") \
        .groupBy("f", word.alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)).alias("bits")).collect() if valued else []
    bitmaps = {f: [0] * KEY_WORDS for f in valued}
    for r in words:
        bitmaps[r["f"]][r["word"]] = r["bits"]
    place = F.array_position(columns, field).cast("int") - 1 + F.when(F.col("rank") == 1, len(types)).otherwise(0)
    needed = {tuple(r) for r in joined.select(place.alias("k"), F.explode(F.flatten(F.transform("criteria", lambda c: F.array(c["field"], c["base"])))).alias("f"))
              .filter(F.array_contains(columns, F.col("f"))).distinct().collect()}
    under = bounded.withColumn("rule_key", F.explode(keys)).select(
        place.alias("rule_field"), F.col("rule_key.key").alias("rule_key"), F.col("rule_key.chunk").alias("rule_chunk"), F.col("low.n").alias("low"), F.col("high.n").alias("high"),
        "rule_id", "score", "label", "either", "key_at", "texts", "checks")

    # Rows under the keys of their values.
    read = sorted({f for f, _, _ in asked} | {b for _, _, b in asked if b is not None})
    taken = {f: f"row_{i}" for i, f in enumerate(dict.fromkeys([*keep, id_field, *read]))}
    cells = {f: F.col(taken[f]) for f in read}

    def asked_for(f: str) -> Column:
        key = _row_key(F.col(taken[f]), types[f])
        word, bit = _key_bit(key)
        return F.when(F.getbit(F.get(const_array(bitmaps[f], "bigint"), word), bit) == 1, key)

    own = [F.struct(F.lit(number[f]).alias("row_field"), asked_for(f).alias("row_key"), F.lit(1).alias("n")) for f in valued]
    seats = {f: f"seat_{i}" for i, f in enumerate(sorted({f for f, _ in chunks}))}
    for (f, level), n in sorted(chunks.items()):
        node = F.expr(f"{seats[f]} div {FAN**level}").cast("int")
        held_here = F.get(const_array(n, "int"), node)
        own.append(F.struct(F.lit(len(types) + number[f]).alias("row_field"), F.when(held_here > 0, _node_key(level, node)).alias("row_key"), held_here.alias("n")))
    head = [F.col(taken[k]).alias(k) for k in keep]
    ids = F.col(taken[id_field])
    out = [*keep, "target_id", "rule_id", "label", "score", "confidence", "evidence", "features", "subject", "note"]
    parts = []
    if own:
        seated = _seated(df.select(*[qcol(f).alias(a) for f, a in taken.items()]), [(taken[f], seat, cuts[f]) for f, seat in seats.items()])
        rows = seated.select(*taken.values(), F.explode(F.array(*own)).alias("k")).filter("k.row_key is not null")
        dealt = any(n > 1 for ns in chunks.values() for n in ns)
        if dealt:
            rows = rows.withColumn("row_chunk", F.explode(F.sequence(F.lit(0), F.col("k.n") - 1)))
        # Under a key a row keeps what rules under such keys read.
        named_by = {f: sorted(k for k, n in needed if n == f) for f in read}
        kept = [F.when(F.col("k.row_field").isin(named_by[f]), F.col(a)).alias(a) if f not in (*keep, id_field) else F.col(a) for f, a in taken.items()]
        rows = rows.select(*kept, "k.row_field", "k.row_key", *(["row_chunk"] if dealt else []))
        x = F.lit(None).cast("double")
        for f in seats:
            x = F.when(F.col("row_field") == len(types) + number[f], cells[f].cast("double")).otherwise(x)
        inside = (F.col("low").isNull() | (x >= F.col("low"))) & (F.col("high").isNull() | (x <= F.col("high")))
        # The key first: sorts compare its prefix.
        same = (F.col("row_key") == F.col("rule_key")) & (F.col("row_field") == F.col("rule_field"))
        pairs = rows.join(under, same & ((F.col("row_chunk") == F.col("rule_chunk")) if dealt else F.lit(True)) & inside)
        passes = lambda c: _holds(c, asked, cells, types)
        hit = pairs.filter(F.when(F.col("either"), F.array_position(F.transform("checks", passes), True) == F.col("key_at") + 1).otherwise(F.forall("checks", passes)))
        chosen = F.filter("texts", lambda _, i: passes(F.get("checks", i)))
        score = normalise_score(F.coalesce("score", F.lit(0.7)))
        shown = F.when(F.col("either"), chosen).otherwise(F.col("texts"))
        parts.append(hit.select(*head, python_text(ids, types[id_field]).alias("target_id"), F.col("rule_id").cast("long").alias("rule_id"),
                                F.coalesce("label", F.lit("rule_match")).alias("label"),
                                score.alias("score"), confidence_band(score).alias("confidence"), shown.alias("evidence"),
                                F.concat(F.lit('{"rule_id":'), F.col("rule_id").cast("string"), F.lit("}")).alias("features"),
                                F.to_json(F.struct(ids.alias(id_field)), {"ignoreNullFields": "false"}).alias("subject"), F.lit(NOTE).alias("note")))
    parts += _scanned(df, rules, ranked, id_field, keep)
    if not parts:
        return empty_signals(df)
    result = parts[0].select(*out)
    for p in parts[1:]:
        result = result.unionByName(p.select(*out))
    return result


def _scanned(df: DataFrame, rules: DataFrame, ranked: DataFrame, id_field: str, keep: list[str]) -> list[DataFrame]:
    """The rules without a key, by a scan."""
    lone = ranked.filter("scanned and size(criteria) > 0").select("rule_id").distinct()
    got = rules.join(lone, "rule_id", "left_semi").limit(MOST_SCANNED + 1).collect()
    if len(got) > MOST_SCANNED:
        raise ValueError(f"more than {MOST_SCANNED} rules have no criterion to look up and would see every row")
    if not got:
        return []
    document = rules_from_table([r.asDict(recursive=True) for r in got])
    return [evaluate(df, document | {"id_field": id_field}, keep)]
