"""Documents, chunks, hybrid search, identity."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphlake.functions import chunks as C
from graphlake.functions import text as T
from graphlake.operators import aggregates, documents, identity
from graphlake.plans.registry import query
from graphlake.sources.tables import dialog, table


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@query("SELECT sha256(coalesce(text, '')) AS content_hash, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def content_hash_dups(spark, sf_dir):
    return aggregates.content_duplicates(_docs(spark, sf_dir))


SENTENCES = ["Frame 0x1A2B answered, frame 0x1 did not.", "CheckoutService calls PaymentGateway2 today.", "ZETA_ONE then ALPHA_TWO then MIDDLE_THREE.", "plain prose, lower_snake too", "Ab A_B"]


@query("""SELECT * FROM (VALUES (0, '0x1A2B'), (1, 'CheckoutService|PaymentGateway2'), (2, 'ALPHA_TWO|ZETA_ONE'), (3, ''), (4, '')) AS t(id, found)""")
def identifiers(spark, sf_dir):
    df = spark.createDataFrame(list(enumerate(SENTENCES)), "id int, text string")
    return df.select("id", F.array_join(T.identifiers(F.col("text"), cap=2), "|").alias("found"))


@query()
def chunk_split(spark, sf_dir):
    return C.chunk(_docs(spark, sf_dir)).select("doc_id", "chunk_no", F.length("text").alias("n_chars"))


@query()
def chunk_next_edges(spark, sf_dir):
    return documents.chunk_links(C.chunk(_docs(spark, sf_dir)))[1]


@query("SELECT conv_id * 10000 + turn AS src, lead(conv_id * 10000 + turn) OVER (PARTITION BY conv_id ORDER BY turn) AS dst FROM conversations QUALIFY dst IS NOT NULL")
def dialog_next(spark, sf_dir):
    return dialog(spark, sf_dir).edges.select("src", "dst")


_TWO = """a AS (SELECT doc_id, len(regexp_extract_all(text, '(?i)the')) AS s FROM documents), b AS (SELECT doc_id, length(text) AS s FROM documents),
  ra AS (SELECT doc_id, row_number() OVER (ORDER BY s DESC, doc_id) AS rank FROM a QUALIFY rank <= 50), rb AS (SELECT doc_id, row_number() OVER (ORDER BY s DESC, doc_id) AS rank FROM b QUALIFY rank <= 50),
  f AS (SELECT doc_id, sum(1.0 / (60 + rank)) AS score FROM (SELECT * FROM ra UNION ALL SELECT * FROM rb) GROUP BY doc_id)"""


@query(f"WITH {_TWO} SELECT doc_id, round(CAST(score AS DOUBLE), 6) AS score FROM f ORDER BY round(CAST(score AS DOUBLE), 9) DESC, doc_id LIMIT 10")
def rrf_fuse(spark, sf_dir):
    d = _docs(spark, sf_dir)
    depth = documents.depth_for(10)
    a = documents.rank_list(d.select("doc_id", F.regexp_count("text", F.lit("(?i)the")).alias("score")), depth)
    b = documents.rank_list(d.select("doc_id", F.length("text").alias("score")), depth)
    return documents.fuse(a, b, k=10).select("doc_id", F.round("score", 6).alias("score"))


@query("SELECT conv_id AS doc_id, CAST(max(length(text)) AS BIGINT) AS score, count(*) AS n_chunks FROM conversations GROUP BY conv_id")
def group_by_document(spark, sf_dir):
    t = table(spark, sf_dir, "conversations")
    return documents.group_by_document(t.select(F.col("conv_id").alias("doc_id"), F.length("text").cast("long").alias("score")))


@query("""WITH h AS (SELECT conv_id, turn FROM conversations WHERE turn = 1)
  SELECT c.conv_id AS doc_id, h.turn AS hit, c.turn AS chunk_no, c.text FROM conversations c JOIN h ON h.conv_id = c.conv_id AND c.turn BETWEEN h.turn - 1 AND h.turn + 1""")
def context_window(spark, sf_dir):
    t = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("chunk_no"), "text")
    return documents.context(t, t.where("chunk_no = 1"), 1)


_WORDS = "[x FOR x IN string_split_regex(text, '\\s+') IF x <> '']"


@query(f"""WITH w AS MATERIALIZED (SELECT doc_id, {_WORDS} AS w FROM documents), b AS MATERIALIZED (SELECT item_id, {_WORDS} AS w FROM benchmark),
  k AS (SELECT item_id, array_to_string(w[i : i + 7], ' ') AS key FROM (SELECT item_id, w, unnest(range(1, len(w) - 6)) AS i FROM b WHERE len(w) >= 8)),
  d AS (SELECT doc_id, array_to_string(w[i : i + 7], ' ') AS key FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8)),
  s AS (SELECT doc_id, item_id FROM w JOIN b ON contains(' ' || array_to_string(w.w, ' ') || ' ', ' ' || array_to_string(b.w, ' ') || ' ') WHERE len(b.w) BETWEEN 1 AND 7)
  SELECT DISTINCT doc_id, item_id FROM d JOIN k USING (key) UNION SELECT doc_id, item_id FROM s""")
def mentions_links(spark, sf_dir):
    return documents.passages(_docs(spark, sf_dir), table(spark, sf_dir, "benchmark"))


@query("""SELECT upper(event_type) || '|' || lower(trim(CAST(user_id AS VARCHAR))) AS entity_key, count(DISTINCT event_id) AS n FROM events
  WHERE lower(event_type) = 'click' GROUP BY 1 ORDER BY n DESC, entity_key LIMIT 20""")
def entity_mentions(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), F.lit(0).alias("chunk_no"), F.col("event_type").alias("label"), F.col("user_id").cast("string").alias("entity"))
    return documents.mention_counts(documents.entities(e), kind="Click", top=20)


def _serial():
    """The customer's name as a serial, which may not hold the sign."""
    return identity.claim_key("serial", F.replace("c_name", F.lit("#"), F.lit("-"))).alias("claim")


@query("SELECT c_custkey AS id, 'serial:' || upper(trim(replace(c_name, '#', '-'))) AS claim FROM customer")
def claims_canonical(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), _serial())


@query("""SELECT user_id, event_id, 'ipv4' AS kind, CASE WHEN user_id % 300 < 256 THEN 'ipv4:10.0.0.' || (user_id % 300) END AS claim FROM events
  UNION ALL SELECT user_id, event_id, 'fronius-unique-id', 'fronius-unique-id@roof:' || upper(event_type) FROM events WHERE regexp_full_match(upper(event_type), '[A-Z0-9]{1,32}')
  UNION ALL SELECT user_id, event_id, 'fronius-unique-id', NULL FROM events WHERE NOT regexp_full_match(upper(event_type), '[A-Z0-9]{1,32}')""")
def claims_scoped(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    address = identity.claim_key("ipv4", F.concat(F.lit(" 10.0.0."), F.col("user_id") % 300)).alias("claim")
    unit = identity.claim_key("fronius-unique-id", F.col("event_type"), "roof").alias("claim")
    return e.select("user_id", "event_id", F.lit("ipv4").alias("kind"), address).unionAll(e.select("user_id", "event_id", F.lit("fronius-unique-id"), unit))


@query("""SELECT c_custkey AS record_id, CASE WHEN c_custkey % 3 = 0 THEN -1 ELSE c_custkey END AS element_id, CASE WHEN c_custkey % 3 = 0 THEN 'create' ELSE 'match' END AS outcome FROM customer""")
def identity_resolve(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("record_id"), _serial(), F.lit("strong").alias("strength"))
    known = c.where("record_id % 3 <> 0").select("claim", F.col("record_id").alias("element_id"))
    return identity.resolve(c, known).withColumn("element_id", F.coalesce("element_id", F.lit(-1)))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'created' WHEN c_custkey % 7 = 0 THEN 'withdrawn' WHEN c_custkey % 5 = 0 THEN 'updated' ELSE 'unchanged' END AS change FROM customer
  WHERE NOT (c_custkey % 10 = 0 AND c_custkey % 7 = 0)""")
def snapshot_diff(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    before = c.where("c_custkey % 10 <> 0")
    now = c.where("c_custkey % 7 <> 0").withColumn("c_acctbal", F.when(F.col("c_custkey") % 5 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")))
    return identity.snapshot_diff(before, now, "c_custkey", ["c_name", "c_acctbal"])


@query("SELECT c_custkey AS record_id, 'missing_nick' AS code FROM customer WHERE c_custkey % 50 = 0")
def snapshot_diagnostics(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("nick", F.when(F.col("c_custkey") % 50 != 0, F.col("c_name")))
    return identity.diagnostics(c, ["c_name", "nick"], "c_custkey")


@query("SELECT p_partkey AS id, 'part ' || p_name || ' of ' || p_brand AS summary FROM part")
def entity_summary(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), identity.summary("part {} of {}", ["p_name", "p_brand"]).alias("summary"))


@query("SELECT doc_id, substr(text, 1, 240) AS preview FROM documents")
def document_previews(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.preview(F.col("text")).alias("preview"))


@query("SELECT id, coalesce(TRY_CAST(v AS INTEGER), -1) AS as_int, coalesce(TRY_CAST(v AS DOUBLE), -1) AS as_double FROM (VALUES (0, '12'), (1, 'x'), (3, '')) AS t(id, v)")
def literal_conversion(spark, sf_dir):
    df = spark.createDataFrame([(0, "12"), (1, "x"), (3, "")], "id int, v string")
    value = lambda kind: F.coalesce(T.literal(F.col("v"), kind), F.lit(-1)).alias(f"as_{kind}")
    return df.select("id", value("int"), value("double"))



@query("""SELECT what, id, n FROM (
    SELECT 'created' AS what, CAST(c_custkey AS VARCHAR) AS id, 2 AS n FROM customer WHERE c_custkey % 11 <> 0 AND c_custkey % 3 = 0
    UNION ALL SELECT 'updated', CAST(c_custkey + 1000000 AS VARCHAR), 1 FROM customer WHERE c_custkey % 11 <> 0 AND c_custkey % 3 <> 0 AND c_custkey % 5 = 0
    UNION ALL SELECT 'withdrawn', CAST(c_custkey + 1000000 AS VARCHAR), 1 FROM customer WHERE c_custkey % 11 = 0 AND c_custkey % 3 <> 0
    UNION ALL SELECT 'deleted', CAST(c_custkey + 1000000 AS VARCHAR), 1 FROM customer WHERE c_custkey % 11 = 0 AND c_custkey % 3 <> 0 AND c_custkey % 2 = 1 AND c_custkey % 7 <> 0)""")
def snapshot_apply(spark, sf_dir):
    """Elements of two thirds of the customers; every 11th has left the snapshot, even
    ones have a second claimant, every 7th is durable."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", _serial())
    props = lambda bal: F.create_map(F.lit("custkey"), F.col("c_custkey").cast("string"), F.lit("balance"), bal.cast("string"))
    now = c.where("c_custkey % 11 <> 0")
    records = now.select(F.col("c_custkey").alias("record_id"), props(F.when(F.col("c_custkey") % 5 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal"))).alias("props"))
    claims = now.select(F.col("c_custkey").alias("record_id"), "claim", F.lit("strong").alias("strength"))
    old = c.where("c_custkey % 3 <> 0").withColumn("element_id", F.col("c_custkey") + 1_000_000)
    elements = old.select("element_id", props(F.col("c_acctbal")).alias("props"), (F.col("c_custkey") % 7 == 0).alias("durable"))
    claimants = old.select("element_id", F.explode(F.when(F.col("c_custkey") % 2 == 0, F.array(F.lit("crm"), F.lit("erp"))).otherwise(F.array(F.lit("crm")))).alias("instance"))
    done = identity.apply_snapshot(records, claims, elements, old.select("claim", "element_id"), claimants, "crm", complete=True)
    named = lambda what, df, c, n: df.select(F.lit(what).alias("what"), F.col(c).cast("string").alias("id"), n.cast("int").alias("n"))
    out = named("created", done.created, "record_id", F.size("props")).unionAll(named("updated", done.updated, "element_id", F.size("props")))
    return out.unionAll(named("withdrawn", done.withdrawn, "element_id", F.lit(1))).unionAll(named("deleted", done.deleted, "element_id", F.lit(1)))


@query("""SELECT CAST(c_custkey AS VARCHAR) AS record_id, unnest(CASE WHEN c_custkey % 4 = 0 THEN ['unknown-identifier-type', 'no-strong-identifier'] WHEN c_custkey % 4 = 1 THEN ['rejected-identifier-value', 'no-strong-identifier']
    WHEN c_custkey % 4 = 2 THEN ['missing-identifier-scope', 'no-strong-identifier'] ELSE [] END) AS code FROM customer""")
def snapshot_validate(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("record_id"), F.col("c_mktsegment").alias("label"), F.replace("c_name", F.lit("#"), F.lit("-")).alias("serial"))
    case = lambda *values: F.element_at(F.array(*values), (F.col("record_id") % 4 + 1).cast("int"))
    kind = case(F.lit("badge"), F.lit("mac"), F.lit("fronius-unique-id"), F.lit("serial"))
    claims = c.select("record_id", kind.alias("type"), case(F.lit("x"), F.lit("no mac"), F.lit("476"), F.col("serial")).alias("value"))
    return identity.validate(c.select("record_id", "label"), claims)


@query("""SELECT doc_id, 0 AS chunk_no, CAST(s AS DOUBLE) AS score FROM (SELECT doc_id, len(regexp_extract_all(text, '(?i)the|der')) AS s FROM documents) WHERE s > 0 ORDER BY s DESC, doc_id LIMIT 25""")
def document_search_lexical(spark, sf_dir):
    """No query vector is given, so the fused search falls back to the text."""
    chunks = _docs(spark, sf_dir).select("doc_id", F.lit(0).alias("chunk_no"), "text", F.lit(None).cast("array<float>").alias("vector"))
    return documents.search(chunks, "the der", mode="fused", k=25)[0]


@query("""SELECT d.doc_id, substr(d.text, 1, 240) AS preview, CASE WHEN e.vec_id IS NULL THEN 0 ELSE 1 END AS n_chunks, CASE WHEN e.vec_id IS NULL THEN FALSE ELSE e.label <> 3 END AS stale
  FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id""")
def document_summaries(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"), F.col("label").cast("string").alias("model"))
    return documents.document_list(_docs(spark, sf_dir), e, "3")


@query("SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS stamp, CAST(86400 + event_id AS BIGINT) AS delta FROM events")
def event_stamps(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    created = T.to_stamp(F.col("ts"))
    later = T.from_stamp(created + 86400 + F.col("event_id"))
    return e.select("event_id", created.alias("stamp"), T.modification_delta(created, later).alias("delta"))


@query()
def identifiers_whole(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.identifiers(F.col("text")).alias("found"))
