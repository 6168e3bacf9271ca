"""Streaming plans, stores and upserts over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeloom.operators import store
from citeloom.operators.chunking import chunk_documents
from citeloom.plans.documents import PACK_SQL
from citeloom.session import shared_path
from citeloom.sources import tables as t
from citeloom.streaming import ingest, tokens


def add(reg) -> None:
    @reg.add(
        "stream_ingest_chunks",
        "WITH " + PACK_SQL + "SELECT doc_id, count(*) AS chunks, CAST(sum(length(piece)) AS BIGINT) AS chars FROM chunks GROUP BY doc_id",
    )
    def stream_ingest_chunks(spark, sf):
        source = ingest.table_stream(spark, f"{sf.rstrip('/')}/documents.parquet")
        out = ingest.run_available(
            source.select("doc_id", "text"),
            lambda batch: chunk_documents(batch, overlap=0, plain=True),
            shared_path(spark, "chunks"),
            shared_path(spark, "chunks-state"),
        )
        return spark.read.parquet(out).groupBy("doc_id").agg(
            F.count("*").alias("chunks"), F.sum(F.length("text")).alias("chars")
        )

    @reg.add(
        "stream_marker_fsm",
        """SELECT conv_id * 1000 + turn AS run_id,
          length(CASE WHEN (conv_id + turn) % 3 = 0 THEN '' ELSE text END) AS shown,
          (conv_id + turn) % 3 = 0 AS withheld FROM conversations WHERE role = 'assistant'""",
    )
    def stream_marker_fsm(spark, sf):
        def events(source):
            c = (F.col("conv_id") + F.col("turn")) % 3
            raw = (
                F.when(c == 0, F.concat(F.lit("<NO_EVIDENCE> "), "text"))
                .when(c == 1, F.concat("text", F.lit("<SOURCES>1,2</SOURCES>")))
                .otherwise(F.col("text"))
            )
            # Seven characters a token, so markers fall across token borders.
            pieces = F.regexp_extract_all(raw, F.lit("(?s).{1,7}"), F.lit(0))
            rows = source.filter("role = 'assistant'").select(
                (F.col("conv_id") * 1000 + F.col("turn")).alias("run_id"),
                F.size(pieces).alias("n"),
                F.posexplode(pieces).alias("seq", "text"),
            )
            return tokens.visible_deltas(
                rows.select(
                    "run_id", F.col("seq").cast("long").alias("seq"), "text",
                    (F.col("seq") == F.col("n") - 1).alias("final"),
                )
            )

        out = ingest.stream_rows(spark, f"{sf.rstrip('/')}/conversations.parquet", events)
        return out.groupBy("run_id").agg(
            F.coalesce(F.sum(F.when(F.col("type") == "delta", F.length("text"))), F.lit(0)).alias("shown"),
            F.bool_or((F.col("type") == "done") & (F.col("text") != "")).alias("withheld"),
        )

    @reg.add(
        "change_log_latest",
        """SELECT user_id AS doc_id, event_type AS status, value FROM events
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""",
    )
    def change_log_latest(spark, sf):
        log = t.table(spark, sf, "events").select(
            F.col("user_id").alias("doc_id"), F.col("event_type").alias("status"), "value", "ts", "event_id"
        )
        return store.latest(log, ["doc_id"], ["ts", "event_id"]).select("doc_id", "status", "value")

    @reg.add(
        "upsert_tables",
        """SELECT c_custkey, CASE WHEN o.k IS NOT NULL THEN 'changed' ELSE 'kept' END AS state,
          round(coalesce(o.total, c_acctbal), 2) AS balance
        FROM customer LEFT JOIN (SELECT o_custkey AS k, max(o_totalprice) AS total FROM orders GROUP BY 1) o ON o.k = c_custkey""",
    )
    def upsert_tables(spark, sf):
        old = t.table(spark, sf, "customer").select(
            "c_custkey", F.lit("kept").alias("state"), F.round("c_acctbal", 2).alias("balance")
        )
        new = t.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
            F.lit("changed").alias("state"), F.round(F.max("o_totalprice"), 2).alias("balance")
        )
        both = store.upsert(old, new, ["c_custkey"])
        return both.join(old.select("c_custkey"), "c_custkey", "left_semi")

    @reg.add(
        "patch_metadata",
        """SELECT d.doc_id, coalesce(nullif(l.quality, 0), 30 + d.doc_id % 5) AS authority_level, d.source
        FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
    )
    def patch_metadata(spark, sf):
        old = t.table(spark, sf, "documents").select(
            "doc_id", (F.lit(30) + F.col("doc_id") % 5).alias("authority_level"), "source"
        )
        change = t.table(spark, sf, "labels").select(
            "doc_id", F.nullif(F.col("quality"), F.lit(0)).alias("authority_level")
        )
        return store.patch(old, change, ["doc_id"])

    @reg.add(
        "reindex_decision",
        """SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN true WHEN o_orderstatus <> 'F' THEN o_orderstatus = 'P'
          WHEN o_orderkey % 5 = 0 THEN true ELSE o_totalprice > 200000 + 0.001 END AS again FROM orders""",
    )
    def reindex_decision(spark, sf):
        o = t.table(spark, sf, "orders")
        k = F.col("o_orderkey")
        status = F.when(F.col("o_orderstatus") == "F", "done").when(
            F.col("o_orderstatus") == "P", "failed"
        ).otherwise("processing")
        return o.select(
            k,
            store.needs_reindex(
                k % 7 != 0, status, F.when(k % 5 != 0, F.lit(200000.0)), F.col("o_totalprice")
            ).alias("again"),
        )

    @reg.add(
        "orphan_rows",
        "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 5)",
    )
    def orphan_rows(spark, sf):
        items = t.table(spark, sf, "lineitem").select(
            "l_orderkey", "l_linenumber", F.col("l_partkey").alias("p_partkey")
        )
        parts = t.table(spark, sf, "part").filter("p_size > 5")
        return store.orphan_rows(items, parts, "p_partkey").select("l_orderkey", "l_linenumber")
