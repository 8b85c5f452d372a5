"""Problem 2: what changes in a region's fields from one of its files to the next, and the tables that result.

`profiles` reduces every file to one row a field: JSON types, quantiles, distinct values, words, extremes. Two files are
compared by their profiles only, in one small group for each file of a region: of the fields that go and those that
come, the assignment with the greatest total likeness (Kuhn-Munkres over the scores of `likeness`) gives the renames;
pairs below LIKE are `removed` plus `added`. `writes` and `settings` put all files under one name a column, the first
of its chain of renames, and `columns` gives each column's name, widest type and files.

Defined results: rows without region or file number are left out; text that is not a JSON object has no fields; a
field without any typed value (null, boolean, nested) is never retyped; of a name repeated in one object all values
count; re-sent writes appear once a request id; a region's first file has no changes; empty tables give no row.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from engine.sources.tables import micros, table

FIELD = "array<struct<field string, type string, value string>>"
FILE = ["region_id", "file_no", "file_name"]
LIKE = 0.6


def split_json(text: str) -> Column:
    """The top-level fields of a JSON object with type and text of their values; empty if it is none."""
    import pandas as pd

    def split(s: pd.Series) -> pd.Series:
        import json

        def one(text):
            try:
                pairs = json.loads(text, parse_int=lambda x: ("integer", x), parse_float=lambda x: ("double", x), parse_constant=lambda x: None, object_pairs_hook=list) if text else []
            except ValueError:
                return []
            if not isinstance(pairs, list):
                return []
            typed = lambda v: v if isinstance(v, tuple) else ("string", v) if isinstance(v, str) else (None, None)
            return [(k, *typed(v)) for k, v in pairs if isinstance(k, str)] if all(isinstance(p, tuple) and len(p) == 2 for p in pairs) else []

        return s.map(one)

    return F.pandas_udf(split, FIELD)(text)


def fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each top-level field of each payload, with the JSON type of its value as written."""
    rows = table(spark, sf_dir, "region_requests").where("region_id IS NOT NULL AND file_no IS NOT NULL")
    both = rows.select("request_id", *FILE, F.explode(F.array(*(F.struct(F.lit(p).alias("payload"), F.col(p).alias("text")) for p in ("attrs", "json_data")))).alias("p")).select("request_id", *FILE, "p.*")
    return both.where("text IS NOT NULL").withColumn("f", F.explode(split_json("text"))).select("request_id", *FILE, "payload", "f.*")


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a field of a file is like: its types, the spread of its numbers, the words of its texts."""
    number = F.expr("try_cast(value AS DOUBLE)")
    long = F.regexp_replace(F.lower("value"), r"\b(?=[a-z]*[0-9])[a-z0-9]{8,}\b", "~")
    words = F.split(F.regexp_replace(long, r"[a-z]*[0-9][a-z0-9]*", "#"), "[^a-z#~]+")
    of = fields(spark, sf_dir).withColumn("x", number).withColumn("words", F.when(F.col("x").isNull(), words))
    return of.groupBy(*FILE, "payload", "field").agg(
        F.sort_array(F.collect_set("type")).alias("types"),
        F.count("value").alias("n"), F.count("x").alias("n_x"), F.approx_count_distinct("value").alias("n_values"),
        F.percentile_approx("x", [0.0, 0.1, 0.5, 0.9, 1.0]).alias("q"),
        F.max(F.length(F.regexp_extract("value", r"\.([0-9]*[1-9])0*$", 1))).alias("decimals"),
        F.array_remove(F.array_distinct(F.flatten(F.collect_set("words"))), "").alias("words"),
        F.avg(F.size("words")).alias("n_words"), F.avg(F.col("value").rlike("[0-9]").cast("int")).alias("digits"), F.avg(F.col("value").startswith("{").cast("int")).alias("json"),
        F.min("value").alias("least"), F.max("value").alias("most"),
    )


def likeness(a, b) -> float:
    """How well the values and the name of field b carry on the quantity of field a; LIKE is enough."""
    import math
    import re

    def tokens(s):
        return {t.lower() for t in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+", s)}

    def plain(s):
        return re.sub("[^a-z0-9]", "", s.lower())

    if plain(a["field"]) == plain(b["field"]):
        return 2.0
    ta, tb = tokens(a["field"]), tokens(b["field"])
    named = 0.3 if any(x == y or min(len(x), len(y)) > 2 and (x.startswith(y) or y.startswith(x)) for x in ta for y in tb) else 0
    if not a["n"] or not b["n"]:
        return named * 2
    if a["json"] > 0.5 or b["json"] > 0.5:
        return 0.9 if a["json"] > 0.5 and b["json"] > 0.5 else 0
    if a["least"] == a["most"] == b["least"] == b["most"]:
        return 0.95 + named
    na, nb = a["n_x"] > 0.9 * a["n"], b["n_x"] > 0.9 * b["n"]
    if na != nb:
        return 0
    if a["payload"] == "attrs" and na and max(a["n"], b["n"]) < 4:
        return 2 * named  # a setting that is renamed keeps its value; else only its name can tell
    if not na:
        wa, wb = set(a["words"]), set(b["words"])
        if abs(a["digits"] - b["digits"]) > 0.5 or max(a["n_words"], b["n_words"]) > 1.8 * min(a["n_words"], b["n_words"]) + 0.2:
            return 0
        return len(wa & wb) / max(1, min(len(wa), len(wb))) + named
    qa, qb = a["q"], b["q"]
    serial = lambda p: p["types"] == ["integer"] and p["n_values"] > 0.8 * p["n"] > 3 and p["q"][4] - p["q"][0] < 4 * p["n"]
    if serial(a) and serial(b) and 0 <= qb[0] - qa[0] and qb[0] - qa[4] < 2 * (qa[4] - qa[0]) + 50:
        return 1.0
    few = min(a["n"], b["n"]) < 5
    if not few and ((qa[0] < 0) != (qb[0] < 0) or abs(a["decimals"] - b["decimals"]) > 1):
        return 0
    rows, values = sorted((a["n"], b["n"])), sorted((a["n_values"], b["n_values"]))
    if rows[0] >= 8 and values[1] > 2.5 * values[0] * rows[1] / rows[0]:
        return 0
    squash = lambda x: math.copysign(math.log1p(abs(x) * 10), x)
    (alow, amid, ahigh), (blow, bmid, bhigh) = map(squash, qa[1:4]), map(squash, qb[1:4])
    span = max(ahigh, bhigh) - min(alow, blow)
    common, narrow = max(0.0, min(ahigh, bhigh) - max(alow, blow)), min(ahigh - alow, bhigh - blow)
    overlap = 1.0 if span == 0 else (common / span + (common / narrow if narrow else float(common > 0))) / 2  # few rows may span less than many
    same = 0.2 if a["decimals"] == b["decimals"] else 0 if few else -0.2
    same -= 0.3 if serial(a) != serial(b) else 0
    return overlap - abs(amid - bmid) / (1 + span) + same + named


def assign(score: list[list[float]]) -> list[int]:
    """The column of each row (-1: none) in the one-to-one assignment with the greatest total score; Kuhn-Munkres with potentials, O(n^3)."""
    n, m = len(score), len(score[0]) if score else 0
    size = max(n, m)
    cost = lambda i, j: -score[i][j] if i < n and j < m else 0.0
    u, v, owner = [0.0] * (size + 1), [0.0] * (size + 1), [size] * (size + 1)
    for i in range(size):
        owner[size], j0 = i, size
        least, back, done = [float("inf")] * size, [size] * size, [False] * (size + 1)
        while owner[j0] != size or j0 == size:
            done[j0] = True
            step, nxt = float("inf"), 0
            for j in range(size):
                if not done[j]:
                    c = cost(owner[j0], j) - u[owner[j0]] - v[j]
                    if c < least[j]:
                        least[j], back[j] = c, j0
                    if least[j] < step:
                        step, nxt = least[j], j
            for j in range(size + 1):
                if done[j]:
                    u[owner[j]] += step
                    v[j] -= step
                elif j < size:
                    least[j] -= step
            j0 = nxt
        while j0 != size:
            owner[j0] = owner[back[j0]]
            j0 = back[j0]
    out = [-1] * n
    for j in range(m):
        if owner[j] < n:
            out[owner[j]] = j
    return out


def held(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of each region, numbered in their order by k."""
    files = table(spark, sf_dir, "region_requests").where("region_id IS NOT NULL AND file_no IS NOT NULL").select(*FILE).distinct()
    return files.withColumn("k", F.row_number().over(Window.partitionBy("region_id").orderBy("file_no", "file_name")))


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(region_id, k, file_name, payload, field, change_kind, new_field) of each region's file k against its file k - 1."""
    like, enough, best = likeness, LIKE, assign
    own = held(spark, sf_dir).join(profiles(spark, sf_dir), FILE, "left")

    def compare(d):
        import pandas as pd

        out = []
        region, k = int(d.region_id.iloc[0]), int(d.step.iloc[0])
        if {k - 1, k} <= set(d.k):
            name = d.file_name[d.k == k].iloc[0]
            for payload in ("attrs", "json_data"):
                files = {k - 1: {}, k: {}}
                for r in d[d.payload == payload].to_dict("records"):
                    r["types"] = list(r["types"])
                    r["kind"] = next((t for t in ("string", "double", "integer") if t in r["types"]), "")
                    files[r["k"]][r["field"]] = r
                old, new = files[k - 1], files[k]
                gone, come = sorted(old.keys() - new.keys()), sorted(new.keys() - old.keys())
                score = [[max(0.0, s) if (s := like(old[a], new[b])) >= enough else 0.0 for b in come] for a in gone]
                for a, j in zip(list(gone), best(score) if come else [], strict=False):
                    if j >= 0 and score[gone.index(a)][j] >= enough:
                        out.append((region, k, name, payload, a, "renamed", come[j]))
                pairs = {(x[4], x[6]) for x in out if x[3] == payload}
                out += [(region, k, name, payload, f, "removed", "") for f in gone if f not in {a for a, _ in pairs}]
                out += [(region, k, name, payload, f, "added", "") for f in come if f not in {b for _, b in pairs}]
                out += [(region, k, name, payload, f, "retyped", "") for f in sorted(old.keys() & new.keys()) if old[f]["kind"] and new[f]["kind"] and old[f]["kind"] != new[f]["kind"]]
        return pd.DataFrame(out, columns=["region_id", "k", "file_name", "payload", "field", "change_kind", "new_field"])

    twice = own.withColumn("step", F.explode(F.array("k", F.col("k") + 1)))
    return twice.groupBy("region_id", "step").applyInPandas(compare, "region_id bigint, k int, file_name string, payload string, field string, change_kind string, new_field string")


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return steps(spark, sf_dir).drop("k")


def lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(region_id, payload, names): for each renamed field of a region its first name, and from which to before which file that holds; sees renames only."""

    def follow(d):
        import pandas as pd

        live, closed = {}, []
        for r in sorted(d.to_dict("records"), key=lambda r: (r["k"], r["field"])):
            first, since = live.pop(r["field"], (r["field"], None))
            if since is not None:
                closed.append((r["field"], since, r["k"], first))
            live[r["new_field"]] = (first, r["k"])
        closed += [(f, since, 2**31 - 1, first) for f, (first, since) in live.items()]
        rows = [{"field": f, "since": s, "until": u, "first": n} for f, s, u, n in closed]
        return pd.DataFrame([(int(d.region_id.iloc[0]), d.payload.iloc[0], rows)], columns=["region_id", "payload", "names"])

    renames = steps(spark, sf_dir).where("change_kind = 'renamed'")
    return renames.groupBy("region_id", "payload").applyInPandas(follow, "region_id bigint, payload string, names array<struct<field string, since int, until int, first string>>")


def unified(spark: SparkSession, sf_dir: str, payload: str) -> DataFrame:
    """(request_id, region_id, file_name, k, ts, cells): the payload's rows with their fields under the first names."""
    rows = table(spark, sf_dir, "region_requests").where(F.col(payload).isNotNull() & F.col("region_id").isNotNull() & F.col("file_no").isNotNull())
    rows = rows.select("request_id", *FILE, F.col("ts").alias("ts"), split_json(payload).alias("cells")).join(held(spark, sf_dir), FILE)
    names = lineage(spark, sf_dir).where(F.col("payload") == payload).select("region_id", "names")

    def first_name(c):
        of = F.filter("names", lambda n: (n["field"] == c["field"]) & (n["since"] <= F.col("k")) & (n["until"] > F.col("k")))
        return F.struct(F.coalesce(F.get(of, 0)["first"], c["field"]).alias("field"), c["type"].alias("type"), c["value"].alias("value"))

    return rows.join(names, "region_id", "left").withColumn("cells", F.transform("cells", first_name)).drop("names")


def _as_json() -> Column:
    """One text per row, fields in order of name; of a name repeated in a row the last value holds."""
    last = F.aggregate("cells", F.expr("CAST(map() AS MAP<STRING, STRING>)"), lambda m, c: F.map_concat(F.map_filter(m, lambda k, _: k != c["field"]), F.create_map(c["field"], c["value"])))
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(last))))


def writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The consistent table of all writes."""
    return unified(spark, sf_dir, "json_data").select("request_id", "region_id", "file_name", micros("ts").alias("ts_us"), _as_json().alias("fields"))


def settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The consistent table of all region settings."""
    return unified(spark, sf_dir, "attrs").select("request_id", "region_id", "file_name", _as_json().alias("fields"))


def columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of both tables: name, widest type, first and last file that holds them, number of values."""
    parts = [unified(spark, sf_dir, p).select(F.lit(p).alias("payload"), "region_id", "file_name", "k", F.explode("cells").alias("c")) for p in ("json_data", "attrs")]
    rank = F.when(F.col("c.type") == "string", 2).when(F.col("c.type") == "double", 1).when(F.col("c.type") == "integer", 0)
    by = parts[0].unionAll(parts[1]).groupBy("region_id", "payload", F.col("c.field").alias("column_name"))
    wide = by.agg(F.max(rank).alias("r"), F.min_by("file_name", "k").alias("first_file"), F.max_by("file_name", "k").alias("last_file"), F.count("*").alias("n_values"))
    return wide.withColumn("column_type", F.element_at(F.array(F.lit("integer"), F.lit("double"), F.lit("string")), F.coalesce("r", F.lit(2)) + 1)).drop("r")
