"""Streams over the event table, and captured files through their own source."""

from __future__ import annotations

from pyspark.sql import functions as F

from catloom.operators import readers
from catloom.plans.registry import query, table
from catloom.shared import new_path
from catloom.sources import captures, fixtures
from catloom.streaming import arrivals, epochs


def event_stream(spark, sf, parts=4):
    """The event table as a stream of files, one a batch."""
    path = new_path(spark, "arrivals")
    events = table(spark, sf, "events")
    events.repartition(parts, "event_id").write.parquet(path)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)


@query("epoch_output", "SELECT event_id, user_id, event_type FROM events")
def epoch_output(spark, sf):
    """All events, through an output that commits by epoch."""
    return epochs.epochs_of(event_stream(spark, sf).select("event_id", "user_id", "event_type")).select("event_id", "user_id", "event_type")


@query("first_arrivals", "SELECT DISTINCT user_id, CAST(floor(epoch(ts) / 21600) AS BIGINT) * 21600 AS window_s FROM events")
def first_arrivals(spark, sf):
    """Each user once for each six hours, over four batches that all hold rows of all times."""
    stream = event_stream(spark, sf)
    return epochs.epochs_of(arrivals.first_in_window(stream, "user_id", "ts", 21_600)).select("user_id", "window_s")


FORMS = ("offer", "opengraph", "hydration", "script")


@query(
    "capture_readers",
    f"""WITH p AS ({fixtures.PARTS_SQL}) SELECT 'shop' || CAST(key % 4 AS VARCHAR) AS site, 'https://loja.example.com/produto/x-' || CAST(key AS VARCHAR) AS url,
     CASE WHEN key % 4 < 3 THEN name END AS name, CASE WHEN key % 4 < 3 THEN price END AS price, 200 AS status FROM p""",
)
def capture_readers(spark, sf):
    """Captured responses of four sites, each through the reader of its site; the last one has none and passes through."""
    path = new_path(spark, "captures")
    pages = fixtures.mixed_forms(spark, sf, FORMS).select(F.concat(F.lit("shop"), (F.col("key") % 4).cast("string")).alias("site"), "url", F.lit(200).alias("status"), F.col("html").alias("body"))
    pages.write.partitionBy("site").json(path)
    return readers.read_sites(lambda sites: captures.load(spark, path, sites, 1 << 20), {"shop0": "jsonld", "shop1": "opengraph", "shop2": "hydration"}).select("site", "url", "name", "price", "status")
