"""Named queries over the supplied tables, each with SQL that a second engine can run.

Where a query pins cases that SQL can't compute (encoded words, case keys, odd dates), its SQL lists the expected values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.functions.dates import sent_us
from colloquy.functions.headers import effective_references, email_fingerprint, extract_reference_ids, normalize_message_id
from colloquy.functions.text import base_subject, decode_header_text, unicode_casemap_key
from colloquy.operators import threading as T
from colloquy.operators.forest import add_child, descendants, preorder, with_payload
from colloquy.operators.render import serialize_thread_data, serialize_thread_response, thread_texts
from colloquy.plans import mailboxes as M
from colloquy.session import ship
from colloquy.sources.mail import parse_emails, thread_email_messages

_QUERIES: dict = {}
_SQL: dict[str, str] = {}

#: The chain of conversations and its references, for SQL.
CHAIN = "m AS (SELECT conv_id, turn, conv_id * 1000 + turn + 1 AS pos, 'c' || conv_id || '.t' || turn || '@ex' AS id FROM conversations)"
REFS = f"{CHAIN}, r AS (SELECT a.conv_id, a.turn, a.pos, b.turn + 1 AS idx, b.id AS ref FROM m a JOIN m b ON b.conv_id = a.conv_id AND b.turn < a.turn)"
GAPS = f"{REFS}, g AS (SELECT * FROM m WHERE turn <> 0 AND (conv_id + turn) % 5 <> 0), gr AS (SELECT r.* FROM r JOIN g USING (pos))"
FORKS = "f AS (SELECT o_orderkey AS pos, min(o_orderkey) OVER (PARTITION BY o_custkey) AS first, date_trunc('day', o_orderdate) AS d FROM orders)"


def query(sql: str | None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = " ".join(sql.split())
        return f

    return add


def queries() -> dict:
    return {name: (lambda spark, sf_dir, f=f: f(ship(spark), sf_dir)) for name, f in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def positions(df: DataFrame, *names: str) -> DataFrame:
    """Node names of messages as their positions; dummies as null."""
    return df.withColumns({n: F.when(F.col(n).startswith("n:"), F.substring(n, 3, 30).cast("long")) for n in names})


# Scalars


@query(f"WITH {CHAIN} SELECT pos AS input_pos, CASE WHEN turn % 3 = 2 THEN NULL ELSE id END AS id FROM m")
def normalize_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = M.chain(spark, sf_dir)
    dressed = F.when(F.col("turn") % 3 == 0, F.concat(F.lit(" \t<"), "message_id", F.lit("> \n"))).when(F.col("turn") % 3 == 1, F.regexp_replace("message_id", "[<>]", "")).otherwise(" < > ")
    return m.select("input_pos", normalize_message_id(dressed).alias("id"))


@query(f"WITH {REFS} SELECT pos AS input_pos, idx, ref FROM r")
def extract_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    header = F.concat(F.array_join("references", "\r\n "), F.lit(" "), F.coalesce(F.get("references", F.lit(0)), F.lit("")))
    bare = F.when(F.col("turn") % 2 == 0, header).otherwise(F.regexp_replace(header, "[<>]", ""))
    return M.chain(spark, sf_dir).select("input_pos", F.posexplode(extract_reference_ids(bare)).alias("idx", "ref")).select("input_pos", (F.col("idx") + 1).cast("long").alias("idx"), "ref")


@query(f"WITH {CHAIN} SELECT a.pos AS input_pos, b.id AS ref FROM m a JOIN m b ON a.conv_id = b.conv_id AND b.turn = a.turn - 1")
def effective_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = M.replies(spark, sf_dir).withColumn("references", F.array(F.lit(" <> ")))
    return m.select("input_pos", F.explode(effective_references("references", "in_reply_to")).alias("ref"))


@query("SELECT conv_id, turn, sha256(lower('re ' || role || '|' || turn || '||me@ex')) AS fingerprint FROM conversations")
def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = M.table(spark, sf_dir, "conversations")
    return t.select("conv_id", "turn", email_fingerprint(F.concat(F.lit(" RE "), "role"), F.col("turn").cast("string"), F.lit(None).cast("string"), F.lit("Me@Ex\t")).alias("fingerprint"))


@query("SELECT event_id, 'topic ' || user_id AS base, event_id % 4 <> 0 AS is_reply FROM events")
def base_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.subjects(spark, sf_dir).withColumn("s", base_subject("subject")).select("event_id", "s.base", "s.is_reply")


_SUBJECTS = [
    ("RE: fw: Fwd: Minutes", "Minutes", True), ("  FWD:\t\r\n  Budget    draft ", "Budget draft", True), ("[ops] Fw: Outage", "Outage", True), ("Fw [ops] : Outage", "Outage", True),
    ("[a] [b] Outage", "Outage", False), ("[a] [b]", "[b]", False), ("[ops]", "[ops]", False), ("Outage(FWD) (fwd)", "Outage", True),
    ("[FWD: [ops] re: Outage (fwd)]", "Outage", True), ("=?utf-8?b?UkU6IENhZsOp?=", "Café", True), ("   ", "", False), ("Fwd", "Fwd", False), ("Reply: x", "Reply: x", False), ("re:re:", "", True),
]


def _values(rows: list[tuple], names: str) -> str:
    one = lambda v: "NULL" if v is None else str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) AS t({names})"


@query(_values([(i, b, r) for i, (_, b, r) in enumerate(_SUBJECTS)], "n, base, is_reply"))
def subject_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.createDataFrame([(i, s) for i, (s, _, _) in enumerate(_SUBJECTS)], "n int, subject string")
    return df.withColumn("s", base_subject("subject")).select("n", "s.base", "s.is_reply")


_WORDS = [
    ("=?iso-8859-15?q?10_=A4?=", "10 €"), ("a =?utf-8?q?=C3=BC?= b", "a ü b"), ("=?koi8-r?b?8NLJ18XU?=", "Привет"), ("=?no-such?q?plain_words?=", "plain words"),
    ("=?utf-8?b?QUJDR?=", "=?utf-8?b?QUJDR?="), ("=?utf-8?q?one?=  =?utf-8?q?two?=", "onetwo"), ("nothing", "nothing"), (None, None),
]


@query(_values([(i, x) for i, (_, x) in enumerate(_WORDS)], "n, decoded"))
def decode_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(_WORDS)], "n int, header string")
    return df.select("n", decode_header_text("header").alias("decoded"))


_KEYS = [("Mail", "MAIL"), ("ﬁn", "fiN"), ("ñ", "N\u0303"), ("ǉ", "Lj"), ("①", "1"), ("ſ", "S"), ("ω", "Ω"), ("½", "1\u20442"), ("", "")]


@query(_values([(i, k) for i, (_, k) in enumerate(_KEYS)], "n, casemap"))
def casemap_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(_KEYS)], "n int, value string")
    return df.select("n", unicode_casemap_key("value").alias("casemap"))


@query("SELECT event_id, epoch_us(ts) // 1000000 * 1000000 - CASE event_id % 5 WHEN 0 THEN 0 WHEN 1 THEN -28800 WHEN 2 THEN 19800 WHEN 3 THEN 3600 ELSE -12600 END::BIGINT * 1000000 AS sent_us FROM events")
def sent_date_utc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.dates(spark, sf_dir).select("event_id", sent_us("sent_date", "internal_date").alias("sent_us"))


_DATES = [
    ("Mon, 9 May 2011 23:15:40 +0430", None, 1_304_966_740_000_000), ("9 May 2011 23:15:40 +9930", None, 1_304_982_940_000_000), ("9 May 2011 25:15:40 +0300", None, 1_304_888_400_000_000),
    ("9 May 2011", None, 1_304_899_200_000_000), (None, "Sat, 22 Nov 2003 02:44:25 -0700", 1_069_494_265_000_000), ("??", "22-Nov-2003 02:44:25 -0700", 1_069_494_265_000_000), ("?", "?", -62_135_596_800_000_000),
    ("Wed, 31 Dec 2008 23:59:60 GMT", None, 1_230_767_999_999_999), ("9 May 2011 noon MST", None, 1_304_924_400_000_000), ("31 Apr 2011 10:00:00 +0000", "2 Jan 2020 03:04:05 +0000", 1_577_934_245_000_000),
    ("31 Dec 9999 23:00:00 -1200", "2 Jan 2020 03:04:05 +0000", 1_577_934_245_000_000), (" ", "2 Jan 2020 03:04:05 +0000", 1_577_934_245_000_000),
]


@query(_values([(i, us) for i, (_, _, us) in enumerate(_DATES)], "n, sent_us").replace("SELECT *", "SELECT n, sent_us::BIGINT AS sent_us"))
def sent_date_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(_DATES)], "n int, sent_date string, internal_date string")
    return df.select("n", sent_us("sent_date", "internal_date").alias("sent_us"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_id + 1 ELSE event_id END AS number, epoch_us(ts) AS sent_us FROM events")
def effective_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = M.subjects(spark, sf_dir).withColumn("sequence_number", F.when(F.col("event_id") % 2 == 0, F.col("event_id") + 1))
    stamps = M.table(spark, sf_dir, "events").select(F.col("event_id").alias("_e"), F.col("ts").alias("sent_date"))
    keys = T.sort_keys(T.identified(e.join(stamps, e["event_id"] == stamps["_e"])))
    return keys.select(F.col("_pos").alias("event_id"), F.col("key.seq").alias("number"), F.col("key.sent_us").alias("sent_us"))


@query(
    """SELECT event_id, CASE event_id % 8 WHEN 0 THEN day - 10800000000 WHEN 1 THEN day WHEN 2 THEN day + 18000000000 WHEN 3 THEN us // 1000000 * 1000000 WHEN 4 THEN us // 60000000 * 60000000 + 59999999
    WHEN 5 THEN day + 28800000000 WHEN 6 THEN us // 1000000 * 1000000 ELSE day END::BIGINT AS sent_us FROM (SELECT event_id, epoch_us(ts) AS us, epoch_us(date_trunc('day', ts)::TIMESTAMP) AS day FROM events)"""
)
def odd_sent_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.odd_dates(spark, sf_dir).select("event_id", sent_us("sent_date", "internal_date").alias("sent_us"))


@query("SELECT conv_id, turn, 'Fw: ' || text AS decoded FROM conversations")
def decoded_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.concat(F.lit("Fw: =?utf-8?B?"), F.regexp_replace(F.base64(F.col("text").cast("binary")), "[\\r\\n]", ""), F.lit("?="))
    return M.table(spark, sf_dir, "conversations").select("conv_id", "turn", decode_header_text(word).alias("decoded"))


#: Lower-case letters of Latin-1 by their base letter, with the marks that they are made of.
_MARKED = {"A": ("àáâãäå", "\u0300\u0301\u0302\u0303\u0308\u030a"), "C": ("ç", "\u0327"), "E": ("èéêë", "\u0300\u0301\u0302\u0308"), "I": ("ìíîï", "\u0300\u0301\u0302\u0308"),
           "N": ("ñ", "\u0303"), "O": ("òóôõö", "\u0300\u0301\u0302\u0303\u0308"), "U": ("ùúûü", "\u0300\u0301\u0302\u0308"), "Y": ("ýÿ", "\u0301\u0308")}
_KEYED = {c: base + mark for base, (letters, marks) in _MARKED.items() for c, mark in zip(letters, marks, strict=True)}
_LATIN = "a-zA-Z0-9 .,;:!?'ßæøþðÆØÞÐ" + "".join(_KEYED) + "".join(_KEYED).upper()
_KEY_CASES = " ".join(f"WHEN lower(c) = '{c}' THEN '{key}'" for c, key in _KEYED.items())


@query(
    f"""WITH t AS (SELECT conv_id, turn, regexp_replace(text, '[^{_LATIN.replace("'", "''")}]', '_', 'g') AS s FROM conversations)
    SELECT conv_id, turn, array_to_string(list_transform(string_split(s, ''), lambda c: CASE {_KEY_CASES} WHEN c = 'ß' THEN c ELSE upper(c) END), '') AS casemap FROM t"""
)
def casemap_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = M.table(spark, sf_dir, "conversations")
    return t.select("conv_id", "turn", unicode_casemap_key(F.regexp_replace("text", f"[^{_LATIN}]", "_")).alias("casemap"))


# Lookups by identifier


@query(f"WITH {CHAIN} SELECT id, pos AS owner_pos FROM m")
def id_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.owners(T.identified(M.doubled(spark, sf_dir))).select("id", "owner_pos")


@query(f"WITH {CHAIN} SELECT pos + 500 AS input_pos, id FROM m WHERE conv_id % 10 = 0")
def duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = T.identified(M.doubled(spark, sf_dir))
    own = T.owners(m).select(F.col("id").alias("_id"), "owner_pos")
    return m.join(own, F.col("id") == F.col("_id")).where("input_pos <> owner_pos").select("input_pos", "id")


@query(f"WITH {GAPS} SELECT DISTINCT ref AS id FROM gr WHERE ref NOT IN (SELECT id FROM g)")
def missing_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = T.identified(M.gaps(spark, sf_dir))
    said = T.mentions(m).select(F.col("ref").alias("id")).distinct()
    return said.join(T.owners(m).select("id"), "id", "left_anti")


@query(
    f"""WITH {GAPS} SELECT 'c' || conv_id || '.t' || (idx - 1) || '@ex' AS parent, 'c' || conv_id || '.t' || idx || '@ex' AS child, pos AS at_pos, idx = turn AS own
    FROM gr"""
)
def reference_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = T.identified(M.gaps(spark, sf_dir))
    met, nodes = T.place_nodes(m)
    names = nodes.select(F.col("node_id").alias("_n"), F.col("message_id").alias("_id"))
    edges = T.proposals(m, met)
    for side in ("parent", "child"):
        edges = edges.join(names, F.col(side) == F.col("_n")).withColumn(side, F.col("_id")).drop("_n", "_id")
    return edges.select("parent", "child", "at_pos", "own")


@query(
    f"""WITH {GAPS}, n AS (SELECT conv_id, turn FROM g UNION SELECT conv_id, idx - 1 FROM gr)
    SELECT 'c' || conv_id || '.t' || turn || '@ex' AS id, CASE WHEN turn > 0 THEN 'c' || conv_id || '.t' || (turn - 1) || '@ex' END AS parent FROM n"""
)
def presumed_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = T.link(M.gaps(spark, sf_dir)).nodes
    names = nodes.select(F.col("node_id").alias("_n"), F.col("message_id").alias("parent"))
    return nodes.join(names, F.col("parent_id") == F.col("_n"), "left").select(F.col("message_id").alias("id"), "parent")


# Forests


def _parents(forest: DataFrame) -> DataFrame:
    f = positions(forest.select("input_pos", F.col("parent_id").alias("parent_pos")), "parent_pos")
    return f.where("input_pos is not null")


@query(f"WITH {CHAIN} SELECT pos AS input_pos, CASE WHEN turn > 0 THEN pos - 1 END AS parent_pos FROM m")
def thread_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parents(T.thread_messages(M.chain(spark, sf_dir)))


@query(f"WITH {CHAIN} SELECT pos AS input_pos, CASE WHEN turn > 0 THEN pos - 1 END AS parent_pos FROM m")
def thread_parent_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parents(T.thread_messages(M.replies(spark, sf_dir)))


@query(f"WITH {CHAIN} SELECT (1000 - turn) * 100000000 + conv_id AS input_pos, CASE WHEN turn > 0 THEN (1001 - turn) * 100000000 + conv_id END AS parent_pos FROM m")
def thread_parent_shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parents(T.thread_messages(M.shuffled(spark, sf_dir)))


@query(
    f"""WITH {CHAIN}, d AS (SELECT pos, turn, pos AS own FROM m UNION ALL SELECT pos + 500, turn, pos FROM m WHERE conv_id % 10 = 0)
    SELECT pos AS input_pos, CASE WHEN turn > 0 THEN own - 1 END AS parent_pos FROM d"""
)
def thread_parent_doubled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parents(T.thread_messages(M.doubled(spark, sf_dir)))


@query(f"WITH {CHAIN} SELECT pos AS input_pos, id, row_number() OVER (ORDER BY pos)::INTEGER AS root_ord FROM m WHERE turn = 0")
def thread_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.thread_messages(M.chain(spark, sf_dir)).where("parent_id is null").select("input_pos", F.col("message_id").alias("id"), "root_ord")


@query(f"WITH {CHAIN} SELECT min(pos) AS root_pos, count(*) AS n_messages FROM m GROUP BY conv_id")
def thread_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    forest = T.thread_messages(M.chain(spark, sf_dir))
    return positions(forest.groupBy(F.col("root_id").alias("root_pos")).agg(F.count("input_pos").alias("n_messages")), "root_pos")


@query(f"WITH {CHAIN} SELECT pos AS input_pos, turn::INTEGER AS depth FROM m")
def thread_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.thread_messages(M.chain(spark, sf_dir)).select("input_pos", "depth")


@query(f"WITH {CHAIN} SELECT pos AS input_pos, (turn + 1)::INTEGER AS preorder, (count(*) OVER (PARTITION BY conv_id) - turn)::INTEGER AS branch FROM m")
def thread_preorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preorder(T.thread_messages(M.chain(spark, sf_dir))).select("input_pos", "preorder", "branch")


@query(f"WITH {CHAIN} SELECT min(pos) AS first_pos, max(pos) AS last_pos, count(*) AS n_messages FROM m GROUP BY conv_id")
def cyclic_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    forest = T.thread_messages(M.circular(spark, sf_dir))
    return forest.groupBy("root_id").agg(F.min("input_pos").alias("first_pos"), F.max("input_pos").alias("last_pos"), F.count("input_pos").alias("n_messages")).drop("root_id")


@query(f"WITH {CHAIN} SELECT pos AS input_pos, CASE WHEN turn > 0 THEN pos - 1 END AS parent_pos FROM m")
def self_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parents(T.thread_messages(M.selfish(spark, sf_dir)))


@query("SELECT a.event_id AS input_pos, CASE WHEN b.event_id > a.event_id THEN b.event_id END AS parent_pos FROM events a LEFT JOIN events b ON b.event_id = a.event_id + 1 - 2 * (a.event_id % 2)")
def mutual_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parents(T.thread_messages(M.mutual(spark, sf_dir)))


@query(f"WITH {CHAIN} SELECT pos AS input_pos, turn::INTEGER AS depth FROM m WHERE turn > 0 AND conv_id = (SELECT min(conv_id) FROM m)")
def descendants_of_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    forest = T.thread_messages(M.chain(spark, sf_dir))
    top = forest.agg(F.min("input_pos")).first()[0]
    return descendants(forest, f"n:{top}").select("input_pos", "depth")


@query(
    f"""WITH {CHAIN}, c AS (SELECT min(conv_id) AS a, (SELECT min(conv_id) FROM m WHERE conv_id > (SELECT min(conv_id) FROM m)) AS b FROM m)
    SELECT pos AS input_pos, CASE WHEN turn > 0 THEN pos - 1 WHEN conv_id = b THEN a * 1000 + 1 END AS parent_pos, (turn + CASE WHEN conv_id = b THEN 1 ELSE 0 END)::INTEGER AS depth FROM m, c"""
)
def moved_branch(spark: SparkSession, sf_dir: str) -> DataFrame:
    forest = T.thread_messages(M.chain(spark, sf_dir))
    a, b = (r[0] for r in forest.where("root_ord <= 2 and parent_id is null").select("node_id").orderBy("root_ord").collect())
    once = add_child(forest, a, b)
    moved = add_child(once, once.where((F.col("root_id") == a) & (F.col("node_id") != b)).orderBy(F.desc("depth")).first()["node_id"], a)  # refused: it would close a cycle
    return positions(moved.select("input_pos", F.col("parent_id").alias("parent_pos"), "depth"), "parent_pos")


@query(f"WITH {GAPS} SELECT pos AS input_pos, lag(pos) OVER (PARTITION BY conv_id ORDER BY turn) AS parent_pos FROM g")
def pruned_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parents(T.thread_messages(M.gaps(spark, sf_dir)))


@query(f"WITH {FORKS} SELECT 'o' || first || '@ex' AS id, count(*) AS n_children FROM f WHERE pos > first GROUP BY first HAVING count(*) > 1")
def retained_dummy_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    forest = T.thread_messages(M.rootless(spark, sf_dir))
    dummies = forest.where("is_dummy").select(F.col("node_id").alias("_n"), F.col("message_id").alias("id"))
    return forest.join(dummies, F.col("parent_id") == F.col("_n")).groupBy("id").agg(F.count("*").alias("n_children"))


@query(f"WITH {FORKS} SELECT pos AS input_pos, (row_number() OVER (PARTITION BY first ORDER BY pos))::INTEGER AS sibling_ord FROM f WHERE pos > first")
def sibling_order_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.thread_messages(M.forks(spark, sf_dir)).where("parent_id is not null").select("input_pos", "sibling_ord")


@query(f"WITH {FORKS} SELECT pos AS input_pos, (row_number() OVER (PARTITION BY first ORDER BY d, pos))::INTEGER AS sibling_ord FROM f WHERE pos > first")
def sibling_order_sent_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.thread_messages(M.forks(spark, sf_dir), sort_by_sent_date=True).where("parent_id is not null").select("input_pos", "sibling_ord")


@query(
    f"""WITH {FORKS}, c AS (SELECT first, pos, d, count(*) OVER (PARTITION BY first) AS n FROM f WHERE pos > first),
    k AS (SELECT first, min(d) AS d, min_by(pos, (d, pos)) AS pos, any_value(n) AS n FROM c GROUP BY first)
    SELECT CASE WHEN n = 1 THEN pos END AS input_pos, CASE WHEN n > 1 THEN 'o' || first || '@ex' ELSE 'o' || pos || '@ex' END AS id, (row_number() OVER (ORDER BY d, pos))::INTEGER AS root_ord FROM k"""
)
def root_order_sent_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.thread_messages(M.rootless(spark, sf_dir), sort_by_sent_date=True).where("parent_id is null").select("input_pos", F.col("message_id").alias("id"), "root_ord")


@query(
    """WITH e AS (SELECT event_id, user_id, event_id % 4 <> 0 AS reply FROM events),
    a AS (SELECT user_id, min(event_id) FILTER (NOT reply) AS original, min(event_id) AS first, count(*) AS n FROM e GROUP BY user_id),
    s AS (SELECT e.user_id, min(event_id) AS start FROM e JOIN a USING (user_id) WHERE CASE WHEN original IS NULL THEN event_id > first ELSE NOT reply AND event_id > original END GROUP BY e.user_id)
    SELECT event_id, CASE WHEN start IS NULL OR (event_id < start AND event_id <> coalesce(original, first)) THEN CASE WHEN event_id <> coalesce(original, first) THEN coalesce(original, first) END ELSE -1 END AS parent_pos
    FROM e JOIN a USING (user_id) LEFT JOIN s USING (user_id)"""
)
def subject_grouped_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    forest = T.thread_messages(M.subjects(spark, sf_dir), group_by_subject=True).where("not is_dummy")
    parent = F.when(F.col("parent_id").startswith("m:"), F.lit(-1).cast("long")).otherwise(F.substring("parent_id", 3, 30).cast("long"))
    return forest.select(F.col("input_pos").alias("event_id"), parent.alias("parent_pos"))


@query(
    f"""WITH {FORKS}, r AS (SELECT f.pos, f.first, o_custkey % 100 AS topic FROM f JOIN orders ON o_orderkey = pos WHERE pos > first),
    d AS (SELECT topic, first, count(*) AS n, min(pos) AS seen FROM r GROUP BY topic, first),
    g AS (SELECT topic, count(*) AS n, arg_min(first, seen) FILTER (n > 1) AS owner FROM d GROUP BY topic)
    SELECT pos AS input_pos, CASE WHEN owner IS NOT NULL THEN 'o' || owner || '@ex' WHEN g.n > 1 THEN 'new' END AS parent FROM r JOIN g USING (topic)"""
)
def subject_grouped_dummies(spark: SparkSession, sf_dir: str) -> DataFrame:
    forest = T.thread_messages(M.topics(spark, sf_dir), group_by_subject=True)
    made = F.when(F.col("parent_id").startswith("m:"), "new").otherwise(F.substring("parent_id", 3, 1 << 20))
    return forest.where("not is_dummy").select("input_pos", made.alias("parent"))


@query(f"WITH {GAPS} SELECT pos AS input_pos, g.conv_id, text FROM g JOIN conversations t ON t.conv_id = g.conv_id AND t.turn = g.turn")
def forest_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = M.table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    m = M.gaps(spark, sf_dir).join(t, ["conv_id", "turn"]).withColumn("node_id", F.lit("a payload column of a clashing name"))
    return with_payload(T.thread_messages(m), m).where("not is_dummy").select("input_pos", "payload.conv_id", "payload.text")


# Responses


@query(f"WITH {CHAIN}, t AS (SELECT conv_id, '(' || string_agg(pos::VARCHAR, ' ' ORDER BY turn) || ')' AS list FROM m GROUP BY conv_id) SELECT 'THREAD ' || string_agg(list, '' ORDER BY conv_id) AS data FROM t")
def imap_thread_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = M.chain(spark, sf_dir)
    return serialize_thread_data(T.thread_messages(m), m, identifier=F.col("input_pos")).select("data")


@query(
    f"""WITH {FORKS}, t AS (SELECT first, count(*) AS n, string_agg('(' || (pos + 7) || ')', '' ORDER BY pos) FILTER (pos > first) AS many, max(pos + 7) AS one FROM f GROUP BY first)
    SELECT '* THREAD ' || string_agg('(' || (first + 7) || CASE n WHEN 1 THEN '' WHEN 2 THEN ' ' || one ELSE ' ' || many END || ')', '' ORDER BY first) AS response FROM t"""
)
def imap_uid_thread(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = M.forks(spark, sf_dir).withColumn("uid", F.col("input_pos") + 7)
    return serialize_thread_response(T.thread_messages(m), m, identifier="uid", line_ending="").select("response")


@query(
    f"""WITH {FORKS}, t AS (SELECT first, first % 3 <> 0 AS top, count(*) FILTER (pos > first AND pos % 3 <> 0) AS n, string_agg('(' || pos || ')', '' ORDER BY pos) FILTER (pos > first AND pos % 3 <> 0) AS many,
    max(pos) FILTER (pos > first AND pos % 3 <> 0) AS one FROM f GROUP BY first)
    SELECT 'THREAD ' || string_agg(CASE WHEN top AND n = 0 THEN '(' || first || ')' WHEN top AND n = 1 THEN '(' || first || ' ' || one || ')' WHEN top THEN '(' || first || ' ' || many || ')'
    WHEN n = 0 THEN '' WHEN n = 1 THEN many ELSE '(' || many || ')' END, '' ORDER BY first) AS data FROM t"""
)
def imap_search_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = M.forks(spark, sf_dir)
    return serialize_thread_data(T.thread_messages(m), m, identifier=F.col("input_pos"), include=F.col("input_pos") % 3 != 0).select("data")


@query(
    """WITH r AS (SELECT o_custkey AS c, o_orderkey + 7 AS pos, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS k FROM orders),
    b AS (SELECT c, (k - 1) // 3 AS j, min(pos) AS pos, list(pos ORDER BY pos)[2:] AS below FROM r WHERE k > 0 GROUP BY c, j),
    t AS (SELECT c, j, pos || CASE len(below) WHEN 0 THEN '' WHEN 1 THEN ' ' || below[1] ELSE ' (' || below[1] || ')(' || below[2] || ')' END AS s FROM b),
    m AS (SELECT c, count(*) AS n, any_value(s) AS one, string_agg('(' || s || ')', '' ORDER BY j) AS many FROM t GROUP BY c)
    SELECT row_number() OVER (ORDER BY pos)::INTEGER AS root_ord, '(' || pos || CASE WHEN n IS NULL THEN '' WHEN n = 1 THEN ' ' || one ELSE ' ' || many END || ')' AS text FROM r LEFT JOIN m USING (c) WHERE k = 0"""
)
def nested_thread_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = M.branches(spark, sf_dir)
    return thread_texts(T.thread_messages(m), m, identifier=F.col("input_pos") + 7).select("root_ord", "text")


@query(
    f"WITH {CHAIN}, t AS (SELECT conv_id, '(' || string_agg((pos * 2)::VARCHAR, ' ' ORDER BY turn) || ')' AS list FROM m WHERE turn % 2 = 0 GROUP BY conv_id) SELECT '* THREAD ' || string_agg(list, '' ORDER BY conv_id) || chr(13) || chr(10) AS response FROM t"
)
def imap_functions_crlf(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = M.chain(spark, sf_dir)
    return serialize_thread_response(T.thread_messages(m), m, identifier=lambda row: 2 * row["input_pos"], include=lambda row: row["turn"] % 2 == 0).select("response")


_REFUSED = [
    ("a number below 1", "SequenceNumberError"), ("a number twice", "SequenceNumberError"), ("a date of another type", "TypeError"), ("an identifier twice", "ThreadSerializationError"), ("an identifier of 0", "ThreadSerializationError"),
    ("an identifier of 33 bits", "ThreadSerializationError"), ("another line ending", "ValueError"), ("another identifier", "ValueError"), ("an include that is no condition", "TypeError"), ("a cycle", "ThreadSerializationError"),
    ("a node twice", "ThreadSerializationError"), ("a parent that isn't there", "ThreadSerializationError"), ("a table of something else", "TypeError"), ("a date of another type that nobody sorts by", "nothing"),
]


@query(_values(_REFUSED, "what, error"))
def refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the engine says to input that is wrong in one way each, over the conversations."""
    m = M.chain(spark, sf_dir)
    forest = T.thread_messages(m)
    by_date = lambda df: T.thread_messages(df, sort_by_sent_date=True)
    text = lambda number, f=forest, **o: serialize_thread_response(f, m, identifier=number, **o)
    pos, first = F.col("input_pos"), F.col("parent_id").isNull()
    odd = m.withColumn("sent_date", F.lit(True))
    cases = [
        lambda: by_date(m.withColumn("sequence_number", pos - pos)), lambda: by_date(m.withColumn("sequence_number", F.col("conv_id") + 1)), lambda: by_date(odd), lambda: text(F.col("conv_id") + 1),
        lambda: text(F.lit(0)), lambda: text(pos + (1 << 32)), lambda: text(pos, line_ending="\n"), lambda: text("number"), lambda: text(pos, include=1),
        lambda: text(pos, forest.withColumn("parent_id", F.col("node_id"))), lambda: text(pos, forest.unionByName(forest)), lambda: text(pos, forest.withColumn("parent_id", F.when(~first, F.lit("n:0")))),
        lambda: text(pos, m), lambda: T.thread_messages(odd).limit(1).count(),
    ]
    rows = []
    for (what, _), case in zip(_REFUSED, cases, strict=True):
        try:
            case()
            rows.append((what, "nothing"))
        except Exception as e:  # noqa: BLE001
            rows.append((what, type(e).__name__))
    return spark.createDataFrame(rows, "what string, error string")


# Raw mail


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = M.chain(spark, sf_dir)
    text = F.concat(
        F.lit("Message-ID: "), "message_id", F.lit("\r\nSubject: =?utf-8?q?caf=C3=A9_"), F.col("conv_id").cast("string"), F.lit("?=\r\nReferences: "), F.array_join("references", "\r\n "),
        F.lit("\r\nDate: Tue, 06 Jun 2017 07:39:33 +0000\r\n\r\nbody\r\n"),
    )
    return m.select("input_pos", "conv_id", text.cast("binary").alias("raw"))


@query(f"WITH {CHAIN} SELECT pos AS input_pos, '<' || id || '>' AS message_id, 'café ' || conv_id AS subject, 'Tue, 06 Jun 2017 07:39:33 +0000' AS sent_date FROM m")
def parsed_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_emails(_raw(spark, sf_dir)).select("input_pos", "message_id", "subject", "sent_date")


@query(f"WITH {CHAIN} SELECT pos AS input_pos, CASE WHEN turn > 0 THEN pos - 1 END AS parent_pos FROM m")
def email_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parents(thread_email_messages(_raw(spark, sf_dir)))
