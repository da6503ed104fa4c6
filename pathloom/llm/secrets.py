r"""Secret scans with corpus-wide ownership frequency; DataFrame functions only.

Candidates are found by patterns in whole texts. The base kinds (assign, access, hex) stand as they
are. Kind ``key`` is any long run of key characters with digits and letters of both cases: random
strings look so, but so do examples that everyone copies. So each candidate's hash is counted over
the corpus by distinct repositories (sources) and owners (the part of a source before ``/``). A run
that more than ``COPIED`` owners have is a copied example; one that looks live and is its owners' own
is added to the spans. Only hashes are grouped, after a distinct by hash and source, and joined back.

Edge cases: a null text is empty and a null source is an owner of its own; rows are told apart by
their place, so repeated rows and null ids each get their spans; no match gives zero counts, the hash
of the empty string and empty spans; long texts are searched whole, and what their matches cost grows
as their number to the power of 1.5; an empty table gives an empty result; extra columns of any name
are kept by ``redact``. Place is that of a scan: the input should be read from files, not be shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, let, table, whole, written

#: Kinds in their order, their patterns, and the least length of group 1 (or of the match).
ASSIGN = r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Runs are maximal, so a least length in the pattern drops what a check afterwards would.
ACCESS, HEX, KEY = r"AKIA[A-Z0-9]{16,}", r"[0-9a-f]{24,}", r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "key")
LEAST_VALUE = 6
#: A key that so many owners have is live-looking; beyond, it is an example that is copied.
COPIED = 2
MARK = "[SECRET]"


def _before(lengths: Column) -> Column:
    """Sums of what stands before each element. Blocks of about the root of the length keep it short for long arrays."""
    n = F.size(lengths)
    width = F.greatest(F.lit(1), F.ceil(F.sqrt(n.cast("double"))).cast("int"))
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)

    def inside(at: Column) -> Column:
        def blocks_of(blocks: Column) -> Column:
            upto = F.transform(blocks, lambda _, b: total(F.slice(blocks, 1, b)))
            return let(upto, lambda u: F.transform(lengths, lambda _, i: u[F.floor(i / at).cast("int")] + total(F.slice(lengths, (F.floor(i / at) * at + 1).cast("int"), i % at))))

        blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / at).cast("int")), lambda b: total(F.slice(lengths, (b * at + 1).cast("int"), at)))
        return let(blocks, blocks_of)

    return F.when(n == 0, F.array().cast("array<int>")).otherwise(let(width, inside))


def _matches(text: Column, pattern: str, kind: int) -> Column:
    """start, kind, end, value of each match; in code points, from the pieces between matches."""
    group = 1 if kind == 0 else 0
    none = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")

    def placed(all_of: Column) -> Column:
        return F.transform(
            F.arrays_zip(all_of["before"], all_of["between"], all_of["found"], all_of["values"]),
            lambda m: F.struct((m["before"] + m["between"]).alias("start"), F.lit(kind).alias("kind"), (m["before"] + m["between"] + F.char_length(m["found"])).alias("end"), m["values"].alias("value")),
        )

    def parts(p: Column) -> Column:
        lengths = F.zip_with(p["between"], p["found"], lambda a, b: a + F.char_length(b))
        return let(
            F.struct(_let_before(lengths).alias("before"), p["between"].alias("between"), p["found"].alias("found"), p["values"].alias("values")), placed
        )

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = found if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    pieces = F.transform(F.split(text, pattern, -1), F.char_length)
    one = let(F.struct(F.slice(pieces, 1, F.greatest(F.lit(0), F.size(pieces) - 1)).alias("between"), found.alias("found"), values.alias("values")), parts)
    return F.when(text.rlike(pattern), one).otherwise(none)


def _let_before(lengths: Column) -> Column:
    return let(lengths, _before)


def candidates(text: Column) -> Column:
    """start, kind (index), end, value of all candidates of a text, in order of start and kind."""
    looks_live = lambda m: m["value"].rlike("[A-Z]") & m["value"].rlike("[a-z]") & m["value"].rlike("[0-9]")
    base = F.concat(F.filter(_matches(text, ASSIGN, 0), lambda m: F.char_length(m["value"]) >= LEAST_VALUE), _matches(text, ACCESS, 1), _matches(text, HEX, 2))
    both = lambda b: F.concat(b, F.filter(F.filter(_matches(text, KEY, 3), looks_live), lambda m: ~F.exists(b, lambda s: (s["start"] < m["end"]) & (m["start"] < s["end"]))))
    return F.sort_array(let(base, both))


def _found(docs: DataFrame, *keep: str | Column) -> DataFrame:
    """place, ``keep``, repository and found (start, kind, end, hash of the value) of every row of ``docs``."""
    found = docs.select(F.monotonically_increasing_id().alias("place"), *keep, F.col("source").alias("repository"), candidates(whole("text")).alias("found"))
    hashed = F.transform("found", lambda m: F.struct(m["start"].alias("start"), m["kind"].alias("kind"), m["end"].alias("end"), F.sha2(m["value"], 256).alias("hash")))
    return found.withColumn("found", hashed)


def _told(rows: DataFrame) -> DataFrame:
    """of_place and spans: the candidates of ``rows`` (place, repository, found) with their owners and verdict."""
    each = rows.select("place", "repository", F.explode("found").alias("m")).select("place", "repository", "m.*")
    by_source = each.select("hash", F.coalesce("repository", F.lit("")).alias("repository"), F.col("repository").isNull().alias("nobody")).distinct()
    owned = by_source.withColumn("owner", F.substring_index("repository", "/", 1))
    owners = owned.groupBy("hash").agg(F.count("*").alias("repositories"), F.count_distinct("owner", "nobody").alias("owners")).withColumnRenamed("hash", "of_hash")
    verdict = F.when(F.col("kind") < KINDS.index("key"), "base").when(F.col("owners") <= COPIED, "live").otherwise("copied")
    told = each.join(owners, each["hash"] == owners["of_hash"]).select("place", F.struct("start", "kind", "end", "repositories", "owners", verdict.alias("verdict")).alias("span"))
    return told.groupBy("place").agg(F.sort_array(F.collect_list("span")).alias("spans")).withColumnRenamed("place", "of_place")


def find_secrets(docs: DataFrame, *keep: str) -> DataFrame:
    """place, the columns ``keep`` and spans of every row of ``docs`` with a candidate.

    spans: start, kind, end, repositories, owners, verdict (base, live or copied).
    """
    rows = cut(_found(docs, *keep).filter(F.size("found") > 0))
    spans = _told(rows)
    return rows.join(spans, rows["place"] == spans["of_place"]).select("place", *keep, "spans")


def _shown(spans: Column) -> Column:
    kind = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", kind[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))))


def redact(docs: DataFrame, mark: str = MARK) -> DataFrame:
    """``docs`` with base and live secrets in its texts replaced by ``mark``; its rows and columns.

    Texts are searched once, and written with what was found; only those with candidates are shuffled.
    """
    found = written(_found(docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("kept_row")), "secrets")
    some = found.filter(F.size("found") > 0)
    spans = _told(some.select("place", "repository", "found")).withColumn("spans", F.filter("spans", lambda s: s["verdict"] != "copied"))

    def cleaned(text: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.lit("").alias("done"))

        def step(acc: Column, s: Column) -> Column:
            new = F.struct(s["end"].alias("at"), F.concat(acc["done"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark)).alias("done"))
            # one that begins inside another only makes it longer
            longer = F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["done"].alias("done"))
            return F.when(s["start"] >= acc["at"], new).otherwise(longer)

        return F.aggregate("spans", start, step, lambda acc: F.concat(acc["done"], F.substring(text, acc["at"] + 1, F.greatest(F.lit(0), F.char_length(text) - acc["at"]))))

    text = F.col("kept_row").getField("text")
    joined = some.select("place", "kept_row").join(spans, F.col("place") == F.col("of_place"))
    new = F.when(F.size("spans") > 0, cleaned(whole(text))).otherwise(text)
    with_some = joined.select(*[new.alias(c) if c == "text" else F.col("kept_row").getField(c).alias(c) for c in docs.columns])
    return found.filter(F.size("found") == 0).select(*[F.col("kept_row").getField(c).alias(c) for c in docs.columns]).unionByName(with_some)


def op6_secret_scans(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = find_secrets(docs, "doc_id").drop("doc_id")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id")
    spans = F.coalesce("spans", F.array().cast(found.schema["spans"].dataType))
    base = F.filter(spans, lambda s: s["verdict"] == "base")
    count = lambda k: F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return rows.join(found, rows["row"] == found["place"], "left").select(
        "doc_id", count(0), count(1), count(2), F.sha2(_shown(base), 256).alias("base_sha256"), _shown(F.filter(spans, lambda s: s["verdict"] != "copied")).alias("spans")
    )


def _sql_kind(number: int, pattern: str, group: int) -> str:
    quoted = pattern.replace("'", "''")
    return f"""
  SELECT place, owner, {number} AS kind, unnest(list_transform(range(1, len(m) + 1), lambda i: {{'s': list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0), 'n': length(m[i]), 'v': v[i]}})) AS x
  FROM (SELECT place, owner, string_split_regex(text, '{quoted}') AS p, regexp_extract_all(text, '{quoted}') AS m, regexp_extract_all(text, '{quoted}', {group}) AS v FROM docs WHERE regexp_matches(text, '{quoted}'))"""


SQL = f"""
WITH docs AS (
  SELECT doc_id AS place, coalesce(text, '') AS text, split_part(source, '/', 1) AS owner FROM documents
), found AS ({" UNION ALL ".join(_sql_kind(k, p, int(k == 0)) for k, p in enumerate((ASSIGN, ACCESS, HEX, KEY)))}
), placed AS (
  SELECT place, owner, kind, CAST(x.s AS BIGINT) AS s, CAST(x.s + x.n AS BIGINT) AS e, x.v AS v FROM found
), base AS (
  SELECT * FROM placed WHERE kind < 3 AND (kind > 0 OR length(v) >= 6)
), keys AS (
  SELECT * FROM placed k WHERE kind = 3 AND regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[0-9]')
  AND NOT EXISTS (SELECT 1 FROM base b WHERE b.place = k.place AND b.s < k.e AND k.s < b.e)
), owned AS (
  SELECT v, count(DISTINCT coalesce(owner, '<none>')) AS owners FROM (SELECT * FROM base UNION ALL SELECT * FROM keys) GROUP BY v
), spans AS (
  SELECT * FROM base UNION ALL SELECT k.* FROM keys k JOIN owned USING (v) WHERE owners <= {COPIED}
), named AS (
  SELECT *, (ARRAY['assign', 'access', 'hex', 'key'])[kind + 1] || ':' || s || ':' || e AS shown FROM spans
), told AS (
  SELECT place, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex,
         string_agg(shown, ',' ORDER BY s, kind) FILTER (WHERE kind < 3) AS base, string_agg(shown, ',' ORDER BY s, kind) AS spans
  FROM named GROUP BY place
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN told ON place = doc_id
"""
