"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

Each text is searched once per kind.  The pieces between matches (split) and the
matches (regexp_extract_all) come from the same leftmost non-overlapping search,
so running sums of their lengths are the positions, in code points.

Candidates are counted over the corpus by hash: a repository is one document,
its owner is its source.  Counting goes from (hash, owner, repository) to
(hash, owner) to hash, each with partial aggregation, so a credential that a
third of the corpus copies is summed before it is shuffled.  A value with more
owners than MAX_OWNERS is a widely copied example; one of fewer, mixed enough
to be random, looks live.  Live-looking tokens outside every base span are
added as spans of kind `token`.

Only hashes and places of values leave the text: no value is stored or
shuffled.

Null text is empty and has no candidates.  A null id or source counts as one
repository or owner of its own.  Repeated rows are one repository, and each
keeps its own row in the result.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import materialize

#: Base patterns: fixed values.
ASSIGN = r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{14,}"  # AKIA and its whole run, of 18 characters or more
HEX = r"(?<![0-9a-f])[0-9a-f]{16,}"  # a whole run of 16 or more
TOKEN = r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*[0-9])[A-Za-z0-9_-]{20,}"
KINDS = ("assign", "access", "hex", "token")
MIN_ASSIGNED = 12
MAX_OWNERS = 1
MIN_DISTINCT = 8

#: begin: where the value begins, in [start, end); random: whether it is mixed enough to be a live credential.
SPAN = "struct<start:int,kind:int,end:int,begin:int,hash:string,random:boolean>"


def _spans(text: Column, pattern: str, kind: int, value_group: int, least: int) -> Column:
    """array<SPAN> of the matches of pattern whose value has `least` characters."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = found if value_group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group))
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("all"), values.alias("value"))
    empty = F.struct(F.lit(0).alias("at"), F.lit(None).cast(f"array<{SPAN}>").alias("out"))
    start = F.struct(empty["at"].alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["gap"])
        end = begin + F.coalesce(F.length(x["all"]), F.lit(0))
        value = x["value"]
        span = F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), (end - F.length(value)).alias("begin"), F.sha2(value, 256).alias("hash"), _looks_random(value).alias("random"))
        return F.struct(end.alias("at"), F.when(F.length(x["value"]) >= least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    walked = F.aggregate(zipped, start, step, lambda acc: acc["out"])
    return F.when(F.size(found) == 0, F.array().cast(f"array<{SPAN}>")).otherwise(walked)


def _free(base: Column, tokens: Column) -> Column:
    return F.filter(tokens, lambda t: ~F.exists(base, lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", carry: Column | None = None) -> DataFrame:
    """(row, doc_id, owner, base, tokens): the spans of every row, computed once;
    with `carry`, also that column."""
    text = F.coalesce(F.col("text"), F.lit(""))
    more = [] if carry is None else [carry.alias("carried")]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(owner_col).cast("string").alias("owner"), *more)
    spans = rows.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "owner", *["carried"] * len(more),
        F.array_sort(F.concat(_spans(text, ASSIGN, 0, 2, MIN_ASSIGNED), _spans(text, ACCESS, 1, 0, 0), _spans(text, HEX, 2, 0, 0))).alias("base"),
        _spans(text, TOKEN, 3, 0, 0).alias("tokens"),
    )
    return materialize(spans.withColumn("tokens", _free(F.col("base"), F.col("tokens"))))


def _looks_random(value: Column) -> Column:
    letters = F.array_distinct(F.split(F.lower(value), ""))
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (F.size(letters) >= MIN_DISTINCT) & ~value.rlike("(?i)example|sample|dummy|placeholder|x{4}|0{6}|1234567")


def ownership(found: DataFrame) -> DataFrame:
    """(hash, repositories, owners) of every candidate value of the corpus."""
    each = found.select("doc_id", "owner", F.explode(F.concat("base", "tokens")).alias("s"))
    rows = each.select("s.hash", F.coalesce("owner", F.lit("")).alias("owner"), "doc_id")
    by_repository = rows.groupBy("hash", "owner", "doc_id").agg(F.count("*").alias("n"))
    by_owner = by_repository.groupBy("hash", "owner").agg(F.count("*").alias("repositories"))
    return by_owner.groupBy("hash").agg(F.sum("repositories").alias("repositories"), F.count("*").alias("owners"))


def judged(found: DataFrame) -> DataFrame:
    """(row, spans) of the rows of candidates() that have any."""
    each = found.select("row", F.explode(F.concat("base", "tokens")).alias("s")).select("row", "s.*")
    each = each.join(ownership(found), "hash")
    live = (F.col("owners") <= MAX_OWNERS) & F.col("random")
    each = each.withColumn("live", live).where(f"kind < {len(KINDS) - 1} or live")
    # a row's spans come from one text: as many as it holds
    return each.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "begin", "hash", "repositories", "owners", "live"))).alias("spans"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source") -> DataFrame:
    """One row per document: doc_id, spans (array of start, kind, end, begin,
    hash, repositories, owners, live), base spans always kept, token spans if live."""
    found = candidates(docs, id_col, text_col, owner_col)
    grouped = judged(found)
    none = F.array().cast(grouped.schema["spans"].dataType)
    return found.join(grouped, "row", "left").select("doc_id", F.coalesce("spans", none).alias("spans"))


def _joined(spans: Column) -> Column:
    name = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """The digest columns of scan()."""
    of = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return scan(docs).select(
        "doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"),
        F.sha2(_joined(F.filter("spans", lambda s: s["kind"] < 3)), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live"), F.size(F.filter("spans", lambda s: s["owners"] > MAX_OWNERS)).cast("long").alias("n_copied"),
    )


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", mark: str = "[secret]") -> DataFrame:
    """docs with every live-looking value, and every assigned value or access
    key, replaced by mark where it stands; other hexadecimal runs that many
    owners share stay.  The columns are those of docs; rows keep their number,
    null and repeated ids included, as spans are joined to their own row.  Rows
    without any candidate are not shuffled."""
    found = candidates(docs, id_col, text_col, owner_col, carry=F.struct(*[F.col(c) for c in docs.columns]))
    any_ = (F.size("base") > 0) | (F.size("tokens") > 0)
    hit = found.where(any_).join(judged(found.where(any_)), "row", "left")
    cut = F.array_sort(F.transform(F.filter("spans", lambda s: (s["kind"] < 2) | s["live"]), lambda s: F.struct(s["begin"].alias("a"), s["end"].alias("b"))))
    text = F.col(f"carried.`{text_col}`").cast("string")

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, s["a"] - acc["at"])
        return F.when(s["a"] >= acc["at"], F.struct(s["b"].alias("at"), F.concat(acc["out"], gap, F.lit(mark)).alias("out"))).otherwise(F.struct(F.greatest(acc["at"], s["b"]).alias("at"), acc["out"].alias("out")))

    tail = lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text)))
    clean = F.aggregate(cut, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, tail)
    clean = F.when(F.size(cut) > 0, clean).otherwise(text).cast(docs.schema[text_col].dataType)
    columns = [F.col(f"carried.`{c}`").alias(c) for c in docs.columns]
    masked = [clean.alias(c) if c == text_col else F.col(f"carried.`{c}`").alias(c) for c in docs.columns]
    return found.where(~any_).select(*columns).unionByName(hit.select(*masked))


def oracle() -> str:
    """The same in DuckDB."""
    assign = r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
    base = [("assign", assign, 2, MIN_ASSIGNED), ("access", "AKIA[A-Z0-9]+", 0, 18), ("hex", "[0-9a-f]+", 0, 16), ("token", "[A-Za-z0-9_-]+", 0, 20)]
    parts = []
    for k, (_, pattern, group, least) in enumerate(base):
        parts.append(f"""
          SELECT row, {k} AS kind, start, start + length(whole) AS "end", value FROM (
            SELECT row, m AS whole, v AS value,
                   (sum(length(g) + length(m)) OVER (PARTITION BY row ORDER BY i) - length(m))::BIGINT AS start
            FROM (SELECT row, unnest(gaps[1:len(ms)]) AS g, unnest(ms) AS m, unnest(vs) AS v, generate_subscripts(ms, 1) AS i
                  FROM (SELECT row, regexp_split_to_array(text, '{pattern}') AS gaps, regexp_extract_all(text, '{pattern}', 0) AS ms,
                               regexp_extract_all(text, '{pattern}', {group}) AS vs FROM d) WHERE len(ms) > 0))
          WHERE length(value) >= {least}""")
    order = "ORDER BY start, kind"
    named = f"""concat_ws(':', ['{"', '".join(KINDS)}'][kind + 1], start, "end")"""
    return f"""
      WITH d AS (SELECT row_number() OVER () AS row, doc_id, source, coalesce(text, '') AS text FROM documents),
      base AS ({" UNION ALL ".join(parts[:3])}),
      tokens AS (SELECT * FROM ({parts[3]}) t WHERE regexp_matches(value, '[0-9]')
                 AND NOT EXISTS (SELECT 1 FROM base b WHERE b.row = t.row AND b.start < t."end" AND t.start < b."end")),
      every AS (SELECT * FROM base UNION ALL SELECT * FROM tokens),
      owners AS (SELECT value, count(DISTINCT coalesce(source, '')) AS owners FROM every JOIN d USING (row) GROUP BY value),
      judged AS (SELECT e.*, owners, owners <= {MAX_OWNERS} AND regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]')
                   AND len(list_distinct(string_split(lower(value), ''))) >= {MIN_DISTINCT}
                   AND NOT regexp_matches(value, '(?i)example|sample|dummy|placeholder|xxxx|000000|1234567') AS live
                 FROM every e JOIN owners USING (value)),
      kept AS (SELECT * FROM judged WHERE kind < 3 OR live),
      folded AS (SELECT row, count(*) FILTER (kind = 0) AS a, count(*) FILTER (kind = 1) AS k, count(*) FILTER (kind = 2) AS h,
                   string_agg({named}, ',' {order}) FILTER (kind < 3) AS b, string_agg({named}, ',' {order}) AS s,
                   count(*) FILTER (live) AS n_live, count(*) FILTER (owners > {MAX_OWNERS}) AS n_copied FROM kept GROUP BY row)
      SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(k, 0) AS n_access, coalesce(h, 0) AS n_hex,
             sha256(coalesce(b, '')) AS base_sha256, coalesce(s, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied
      FROM d LEFT JOIN folded USING (row)"""
