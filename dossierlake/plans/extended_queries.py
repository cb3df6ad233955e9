"""Queries of what goes beyond one audit of given files: edits, indexes, joins in time and sessions, with their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dossierlake.operators import frames, intervals, report, sketches, text_index, versions
from dossierlake.plans import reaudit
from dossierlake.plans.audit import AuditOptions
from dossierlake.plans.driver import BASE, LOW, PROSE, driver_corpus, driver_statuses, driver_texts, sql_text
from dossierlake.plans.whole_audit import COVERED, FINDINGS, PENALTIES, STAGES, TRACK, driver_audit, driver_inventory, whole
from dossierlake.sources import variants
from dossierlake.streaming import sessions as streams
from dossierlake.workspace import materialize, shared_dir, table, text_batches

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None):
    def register(function: Callable[[SparkSession, str], DataFrame]):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLE_SQL[function.__name__] = sql
        return function

    return register


def _edited_files(corpus: DataFrame) -> DataFrame:
    """About one file in twenty, of some projects only, with other words and one more line."""
    number = F.regexp_extract("path", "^0*([0-9]+)", 1).cast("long")
    chosen = corpus.where((number % 13 == 3) & ~F.substring("project_id", -1, 1).isin("0", "2", "4"))
    line = F.concat(F.lit("\ntoken licence version = "), number.cast("string"))
    return chosen.withColumn("text", F.concat(F.replace("text", F.lit(" and "), F.lit(" orders ")), line))


_IS_EDITED = "d.doc_id % 13 = 3 AND right(d.source, 1) NOT IN ('0', '2', '4')"
_EDITED_BASE = BASE.replace(
    "coalesce(d.text, '') AS text",
    f"CASE WHEN {_IS_EDITED} THEN replace(coalesce(d.text, ''), ' and ', ' orders ') || chr(10) || 'token licence version = ' || d.doc_id ELSE coalesce(d.text, '') END AS text",
)
_REAUDIT_SQL = f"""WITH {",".join((_EDITED_BASE, *STAGES[1 : STAGES.index(PENALTIES) + 1]))}
SELECT s.project_id, total_score, trust_debt, evidence_left, coalesce(c.claims, 0) AS claims, coalesce(c.texts, '') AS texts, coalesce(e.verdicts, '') AS verdicts,
       EXISTS (SELECT 1 FROM documents d WHERE d.source = s.project_id AND {_IS_EDITED}) AS touched
FROM scores s
LEFT JOIN (SELECT project_id, count(*) AS claims, md5(string_agg(claim_text, chr(10) ORDER BY claim_id)) AS texts FROM claims GROUP BY 1) c USING (project_id)
LEFT JOIN (SELECT project_id, md5(string_agg(status || ':' || files, chr(10) ORDER BY claim_id)) AS verdicts FROM evidence GROUP BY 1) e USING (project_id)"""


def listed(rows: DataFrame, item: Column, order: str, name: str) -> DataFrame:
    """project_id and the digest of its items in order."""
    each = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), item.alias("item"))))
    return rows.groupBy("project_id").agg(F.md5(F.array_join(F.transform(each, lambda x: x["item"]), "\n").cast("binary")).alias(name), F.count(order).alias("n"))


@query(_REAUDIT_SQL)
def reaudit_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit after an edit of one file in twenty, from the facts of the audit before and the edited files alone."""
    options = AuditOptions(lexicon=PROSE, track=TRACK)
    assets = materialize(driver_inventory(spark, sf_dir), "inventory")
    corpus = driver_corpus(spark, sf_dir)
    before = reaudit.first_audit(assets, driver_texts(spark, sf_dir), options, materialize(driver_statuses(spark, sf_dir), "statuses"))
    after, touched = reaudit.reaudit(before, assets, _edited_files(corpus), options)
    claims = listed(after.claims, F.col("claim_text"), "claim_id", "texts").withColumnRenamed("n", "claims")
    files = F.concat_ws(":", "status", F.array_join("evidence_files", ","))
    verdicts = listed(after.evidence, files, "claim_id", "verdicts").drop("n")
    found = after.scores.join(claims, "project_id", "left").join(verdicts, "project_id", "left")
    found = found.join(touched.withColumn("hit", F.lit(True)), "project_id", "left")
    return found.select(
        "project_id", "total_score", "trust_debt", F.col("dimensions")["声明-证据匹配度"].alias("evidence_left"),
        F.coalesce("claims", F.lit(0)).cast("long").alias("claims"), F.coalesce("texts", F.lit("")).alias("texts"),
        F.coalesce("verdicts", F.lit("")).alias("verdicts"), F.coalesce("hit", F.lit(False)).alias("touched"),
    )


@query("""SELECT event_id, coalesce(click.event_id, -1) AS click_id, coalesce(epoch_us(ts) - epoch_us(click.ts), -1) AS since FROM (
  SELECT event_id, ts, max({'ts': ts, 'event_id': event_id}) FILTER (event_type = 'click') OVER (
    PARTITION BY user_id ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL '1 microsecond' PRECEDING) AS click FROM events)""")
def events_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with its user's last click before it."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    clicks = events.where("event_type = 'click'").select("event_id", "user_id", "ts")
    found = intervals.last_before(events, clicks, "user_id", "ts", "event_id", "click")
    since = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("click.ts").cast("timestamp"))
    return found.select("event_id", F.coalesce("click.event_id", F.lit(-1)).alias("click_id"), F.coalesce(since, F.lit(-1)).alias("since"))


DAY = 86_400_000_000


def micros(column: str) -> Column:
    return F.unix_micros(F.col(column).cast("timestamp"))


@query("""SELECT o.o_orderkey, count(p.o_orderkey) AS n, coalesce(max(p.o_orderkey), -1) AS last_key
FROM orders o LEFT JOIN orders p ON p.o_custkey = o.o_custkey AND p.o_orderkey <> o.o_orderkey
  AND p.o_orderdate BETWEEN o.o_orderdate AND o.o_orderdate + to_days([1, 30, 400][(o.o_orderkey % 3 + 1)::INT])
GROUP BY o.o_orderkey""")
def orders_in_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each order, its customer's further orders in the days after it: windows of 1, 30 and 400 days in one join."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    days = F.element_at(F.array(*map(F.lit, (1, 30, 400))), (F.col("o_orderkey") % 3 + 1).cast("int"))
    start = micros("o_orderdate")
    pairs = intervals.points_in_intervals(orders, orders, start, start + days * DAY, start, base=DAY, keys=("o_custkey",))
    others = pairs.where("interval.o_orderkey <> point.o_orderkey").groupBy(F.col("interval.o_orderkey").alias("o_orderkey"))
    counted = others.agg(F.count(F.lit(1)).alias("n"), F.max("point.o_orderkey").alias("last_key"))
    all_orders = orders.select("o_orderkey").join(counted, "o_orderkey", "left")
    return all_orders.fillna(0, ["n"]).fillna(-1, ["last_key"])


@query("""SELECT e.event_id, count(c.event_id) AS n, coalesce(min(c.event_id), -1) AS first_id
FROM (FROM events WHERE event_type = 'error') e LEFT JOIN (FROM events WHERE event_type = 'click') c
  ON c.ts BETWEEN e.ts - INTERVAL '10 minutes' AND e.ts + to_minutes((e.event_id % 7) * 30)
GROUP BY e.event_id""")
def clicks_around_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each error, clicks of any user around it; no key but time."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "event_type")
    errors, clicks = events.where("event_type = 'error'"), events.where("event_type = 'click'")
    minute = DAY // 1440
    pairs = intervals.points_in_intervals(errors, clicks, micros("ts") - 10 * minute, micros("ts") + (F.col("event_id") % 7) * 30 * minute, micros("ts"), base=10 * minute)
    counted = pairs.groupBy(F.col("interval.event_id").alias("event_id")).agg(F.count(F.lit(1)).alias("n"), F.min("point.event_id").alias("first_id"))
    return errors.select("event_id").join(counted, "event_id", "left").fillna(0, ["n"]).fillna(-1, ["first_id"])


SESSION_HOURS, LATE_HOURS = 6, 24
_HOUR = 3_600_000_000
_ISLANDS = """SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS island FROM (
    SELECT *, CASE WHEN us <= lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id) + {gap} THEN 0 ELSE 1 END AS new FROM {rows})"""
_SESSIONS = f"""WITH timed AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS us FROM events WHERE ts IS NOT NULL),
halves AS (SELECT *, us < (SELECT min(us) + (max(us) - min(us)) // 2 FROM timed) AND event_id % 50 <> 7 AS early FROM timed),
mark AS (SELECT max(us) // 1000 * 1000 - {LATE_HOURS * _HOUR} AS wm FROM halves WHERE early),
early AS (SELECT event_id, user_id, event_type, us FROM halves WHERE early),
one AS ({_ISLANDS.format(gap=SESSION_HOURS * _HOUR, rows="early")}),
ends AS (SELECT *, max(us) OVER (PARTITION BY user_id, island) + {SESSION_HOURS * _HOUR} AS ended FROM one),
closed AS (SELECT user_id, island, event_type, us FROM ends WHERE ended <= coalesce((SELECT wm FROM mark), -9e18)),
rest AS (
  SELECT event_id, user_id, event_type, us FROM ends WHERE ended > (SELECT wm FROM mark)
  UNION ALL
  SELECT event_id, user_id, event_type, us FROM halves WHERE NOT early AND us + {SESSION_HOURS * _HOUR} > coalesce((SELECT wm FROM mark), -9e18)),
two AS ({_ISLANDS.format(gap=SESSION_HOURS * _HOUR, rows="rest")}),
rows AS (SELECT user_id, 'early' AS part, island, event_type, us FROM closed UNION ALL SELECT user_id, 'late', island, event_type, us FROM two)
SELECT user_id, min(us) AS begin_us, max(us) + {SESSION_HOURS * _HOUR} AS ended_us, count(*) AS n, count(*) FILTER (event_type = 'click') AS clicks
FROM rows GROUP BY user_id, part, island"""


@query(_SESSIONS)
def sessions_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of the events table as a stream that comes in two drops, with a restart between.

    The first drop is the first half of the time, but for one event in fifty: those come late, with the second drop,
    and count only where the watermark hasn't passed their session yet.
    """
    events = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")
    middle = events.agg(F.expr("min(unix_micros(ts)) + (max(unix_micros(ts)) - min(unix_micros(ts))) div 2")).first()[0]
    marked = events.withColumn("early", (F.unix_micros("ts") < F.lit(middle)) & (F.col("event_id") % 50 != 7))
    root = f"{shared_dir(spark)}/sessions-{uuid.uuid4().hex}"
    late = marked.where(~F.coalesce("early", F.lit(False))).select(*events.columns)
    end = streams.closing_row(events, "user_id", "ts", f"{SESSION_HOURS + LATE_HOURS + 1} hours")
    make = lambda rows: streams.sessions(
        rows, "user_id", "ts", f"{SESSION_HOURS} hours", f"{LATE_HOURS} hours", F.count_if(F.col("event_type") == "click").alias("clicks")
    )
    for drop in (marked.where("early").select(*events.columns), late.unionByName(end)):
        drop.write.mode("append").parquet(f"{root}/events")
        streams.run_available(f"{root}/events", events.schema, make, f"{root}/sessions", f"{root}/checkpoint")
    found = spark.read.parquet(f"{root}/sessions")
    return found.select("user_id", F.unix_micros("begin").alias("begin_us"), F.unix_micros("ended").alias("ended_us"), "n", "clicks")


#: Needles of the search besides a part of each benchmark item: words, marks, and ones of a letter or two.
NEEDLES = ("a", "z", "|", "é", "zq", "Th", "!!", "und", "ß ", "RELEASED", "no such words at all")


@query(f"""WITH {BASE}, needles AS (
  SELECT DISTINCT needle FROM (SELECT substr(text, 5, 3 + (item_id % 11)::INT) AS needle FROM benchmark
    UNION ALL SELECT unnest([{", ".join(map(sql_text, NEEDLES))}])) WHERE needle <> ''),
lines AS (
  SELECT c.project_id, c.path, t.pos AS line_no, {LOW.format("t.line")} AS low
  FROM corpus c, unnest(string_split(c.text, chr(10))) WITH ORDINALITY AS t(line, pos))
SELECT needle, project_id, path, count(*) AS lines, min(line_no)::BIGINT AS first, max(line_no)::BIGINT AS last
FROM needles n JOIN lines l ON contains(l.low, {LOW.format("n.needle")}) GROUP BY ALL""")
def indexed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some fifty needles in all texts, through an index of grams; no text is read once it is built."""
    folder = f"{shared_dir(spark)}/grams-{uuid.uuid4().hex}"
    text_batches(spark)
    text_index.build_index(driver_texts(spark, sf_dir), folder)
    parts = table(spark, sf_dir, "benchmark").select(F.expr("substr(text, 5, cast(3 + item_id % 11 as int))").alias("needle")).where("needle <> ''")
    needles = sorted({*(r.needle for r in parts.distinct().collect()), *NEEDLES})  # a stated query set
    found = text_index.find_lines(spark, folder, needles)
    return found.select("needle", "project_id", "path", F.size("lines").cast("long").alias("lines"), F.array_min("lines").alias("first"), F.array_max("lines").alias("last"))


@query(
    """SELECT event_id, string_agg('key: ' || k || chr(10) || k || ': ' || json_extract_string(props, '$.' || k) || chr(10), '' ORDER BY k) AS text
FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events) GROUP BY event_id"""
)
def variant_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event properties as VARIANT, flattened on the JVM."""
    return variants.flattened(table(spark, sf_dir, "events"), "event_id", F.col("props"))


@query("""SELECT conv_id, md5('key: about' || chr(10) || 'key: about.conv' || chr(10) || 'about.conv: c' || conv_id || chr(10) || 'key: about.turns' || chr(10) || 'about.turns: ' || count(*) || chr(10)
  || 'key: turns' || chr(10) || string_agg('key: turns[' || i || '].role' || chr(10) || coalesce('turns[' || i || '].role: ' || role || chr(10), '')
  || 'key: turns[' || i || '].text' || chr(10) || coalesce('turns[' || i || '].text: ' || text || chr(10), ''), '' ORDER BY i)) AS digest
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS i FROM conversations) GROUP BY conv_id""")
def variant_flatten_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as one JSON document with an array of objects, flattened."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    about = F.struct(F.concat(F.lit("c"), F.col("conv_id")).alias("conv"), F.size("turns").alias("turns"))
    each = F.transform("turns", lambda t: F.struct(t.role.alias("role"), t.text.alias("text")))
    grouped = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(turns.alias("turns"))
    documents = grouped.select("conv_id", F.to_json(F.struct(each.alias("turns"), about.alias("about")), {"ignoreNullFields": "false"}).alias("json"))
    found = variants.flattened(documents, "conv_id", F.col("json"))
    return found.select("conv_id", F.md5(F.col("text").cast("binary")).alias("digest"))


_CUBE = """SELECT g.project_id, g.role, g.severity, grouping(g.project_id) * 4 + grouping(g.role) * 2 + grouping(g.severity) AS level, count(*) AS findings, count(DISTINCT rule_id) AS rules
FROM (SELECT f.project_id, i.role, f.severity, f.rule_id FROM (SELECT project_id, rule_id, severity, unnest(CASE WHEN files = '' THEN [NULL] ELSE string_split(files, ',') END) AS path FROM findings) f
  LEFT JOIN inventory i ON i.project_id = f.project_id AND i.path = f.path) g
GROUP BY GROUPING SETS ((g.project_id, g.role, g.severity), (g.project_id, g.role), (g.role, g.severity), (g.project_id), (g.role), ())"""


@query(whole(FINDINGS, _CUBE))
def finding_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings by project, role and severity and their sums; a finding without files has a null role, which isn't a sum."""
    audit = driver_audit(spark, sf_dir)
    return report.finding_sums(audit.findings, audit.assets)


@query("""SELECT event_id, CAST(sum(cents) OVER w AS BIGINT) AS hour_cents, count(*) OVER w AS hour_events,
  row_number() OVER o AS place, percent_rank() OVER o AS percent_rank, ntile(7) OVER o AS ntile,
  coalesce(last_value(CASE WHEN event_type = 'purchase' OR event_type = 'error' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), -1) AS last_error
FROM (SELECT *, epoch_us(ts) AS us, CAST(round(value * 100) AS BIGINT) AS cents, CASE WHEN user_id % 3 = 0 THEN 0 ELSE user_id END AS owner FROM events)
WINDOW w AS (PARTITION BY owner ORDER BY us RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW), o AS (PARTITION BY owner ORDER BY us, event_id)""")
def events_range_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames over the events of each owner, one of whom has a third of them: sums of the last hour, ranks, last known values."""
    events = table(spark, sf_dir, "events").select(
        "event_id", "user_id", micros("ts").alias("us"), F.round(F.col("value") * 100).cast("long").alias("cents"),
        F.when(F.col("user_id") % 3 == 0, 0).otherwise(F.col("user_id")).alias("owner"),
        F.when(F.col("event_type").isin("purchase", "error"), F.col("event_id")).alias("bad"),
    )
    events = materialize(events.withColumn("one", F.lit(1).cast("long")), "events")
    hour = DAY // 24
    sums = frames.range_sums(events, "owner", "us", "event_id", ["cents", "one"], hour, ["hour_cents", "hour_events"]).select("event_id", "hour_cents", "hour_events")
    ranked = frames.places(events.withColumn("order", F.struct("us", "event_id")), "owner", "order", 7)
    known = frames.last_known(events, "user_id", "us", "event_id", "bad", "last_error").select("event_id", F.coalesce("last_error", F.lit(-1)).alias("last_error"))
    return ranked.select("event_id", "place", "percent_rank", "ntile").join(sums, "event_id").join(known, "event_id")


_SKETCHES = f"""WITH each AS (
  SELECT o_custkey % 25 AS nation, o_orderpriority, o_custkey, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders)
SELECT coalesce(CAST(nation AS VARCHAR), 'all') AS nation, coalesce(o_orderpriority, 'all') AS priority, count(*) AS rows, count(DISTINCT o_custkey) AS customers,
  TRUE AS distinct_within, TRUE AS quartiles_within
FROM each GROUP BY ROLLUP (nation, o_orderpriority)"""


@query(_SKETCHES)
def sketch_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and quartiles of prices by nation and priority, merged upwards from sketches, within their bounds of the
    exact counts: four standard errors of a distinct count, three rank errors of a quartile."""
    orders = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 25).alias("nation"), "o_orderpriority", "o_custkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    fine = materialize(sketches.sketches(orders, ["nation", "o_orderpriority"], F.col("o_custkey"), F.col("cents")), "sketches")
    middle = sketches.merged(fine, ["nation"]).withColumn("o_orderpriority", F.lit(None).cast("string"))
    total = sketches.merged(middle, []).withColumn("nation", F.lit(None).cast("long")).withColumn("o_orderpriority", F.lit(None).cast("string"))
    told = sketches.estimates(fine.unionByName(middle).unionByName(total), ["nation", "o_orderpriority"])
    n, p = F.col("nation"), F.col("o_orderpriority")
    exact = orders.groupingSets([[n, p], [n], []], n, p).agg(F.count_distinct("o_custkey").alias("customers")).withColumnsRenamed({"nation": "n", "o_orderpriority": "p"})
    both = materialize(told.join(exact, F.col("nation").eqNullSafe(F.col("n")) & F.col("o_orderpriority").eqNullSafe(F.col("p"))), "estimates")
    # the ranks that the quartiles really have, in one pass over the orders
    small = F.broadcast(both.select("n", "p", "quantiles"))  # one row a nation and priority
    at = orders.join(small, (F.col("nation") == F.col("n")) & (F.col("o_orderpriority") == F.col("p")))
    top = both.where("n is null").first()
    everything = orders.select("*", F.lit(None).cast("long").alias("n"), F.lit(None).cast("string").alias("p"), F.array(*map(F.lit, top.quantiles)).alias("quantiles"))
    at = at.unionByName(orders.join(small, (F.col("nation") == F.col("n")) & F.col("p").isNull())).unionByName(everything)
    below = [F.count_if(F.col("cents") < F.col("quantiles")[i]).alias(f"under{i}") for i in range(3)] + [F.count_if(F.col("cents") <= F.col("quantiles")[i]).alias(f"upto{i}") for i in range(3)]
    ranks = at.groupBy("n", "p").agg(*below).withColumnsRenamed({"n": "n2", "p": "p2"})
    found = both.join(ranks, F.col("n").eqNullSafe(F.col("n2")) & F.col("p").eqNullSafe(F.col("p2")))
    slack = 3 * sketches.RANK_ERROR
    fits = [(F.col(f"under{i}") / F.col("rows") <= q + slack) & (F.col(f"upto{i}") / F.col("rows") >= q - slack) for i, q in enumerate((0.25, 0.5, 0.75))]
    near = F.abs(F.col("distinct") - F.col("customers")) <= F.greatest(4 * sketches.DISTINCT_ERROR * F.col("customers"), F.lit(0.5))
    return found.select(
        F.coalesce(F.col("nation").cast("string"), F.lit("all")).alias("nation"), F.coalesce("o_orderpriority", F.lit("all")).alias("priority"),
        "rows", "customers", near.alias("distinct_within"), (fits[0] & fits[1] & fits[2]).alias("quartiles_within"),
    )


_COUNTED = ("assets", "corpus", "profiles", "profiles", "claims", "evidence", "issues", "findings", "scores", "tasks")
_STAGE_ROWS = " UNION ALL ".join(
    f"SELECT '{name}' AS stage, count(*) AS rows FROM {of}"
    for name, of in zip(("assets", "corpus", "types", "profile", "claims", "evidence", "issues", "findings", "scores", "tasks"), _COUNTED, strict=True)
) + " UNION ALL SELECT 'plan', count(DISTINCT project_id) FROM tasks"


@query(whole(COVERED, _STAGE_ROWS))
def audit_stage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the audit's eleven stages, counted by one run's own jobs."""
    found = driver_audit(spark, sf_dir).observed(f"audit-{uuid.uuid4().hex}")
    return spark.createDataFrame(list(found.items()), "stage string, rows long")


_SCORES_OF = f"WITH BASE_OF, {','.join(STAGES[1 : STAGES.index(PENALTIES) + 1])} SELECT project_id, total_score FROM scores"


@query(f"SELECT a.project_id, a.total_score AS before, b.total_score AS after FROM ({_SCORES_OF.replace('BASE_OF', BASE)}) a JOIN ({_SCORES_OF.replace('BASE_OF', _EDITED_BASE)}) b USING (project_id)")
def session_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An audit and its re-audit as two versions of a session, read side by side; a write from the old version is refused."""
    options = AuditOptions(lexicon=PROSE, track=TRACK)
    assets = materialize(driver_inventory(spark, sf_dir), "inventory")
    corpus = driver_corpus(spark, sf_dir)
    stored = versions.Sessions(spark, f"{shared_dir(spark)}/sessions-{uuid.uuid4().hex}")
    first = reaudit.first_audit(assets, driver_texts(spark, sf_dir), options, materialize(driver_statuses(spark, sf_dir), "statuses"))
    start = stored.commit({"scores": first.scores, "claims": first.claims, "evidence": first.evidence})
    after, _ = reaudit.reaudit(first, assets, _edited_files(corpus), options)
    stored.commit({"scores": after.scores, "claims": after.claims, "evidence": after.evidence}, base=start)
    try:
        stored.commit({"scores": first.scores}, base=start)
    except versions.Conflict:
        pass
    old, new = stored.read(start)["scores"], stored.read()["scores"]
    return old.select("project_id", F.col("total_score").alias("before")).join(new.select("project_id", F.col("total_score").alias("after")), "project_id")
