"""Driver query for the overwrite of late arrivals."""

from pyspark.sql import functions as F

from ..storage import Scratch, new_path
from .late_overwrite import Layout, day_of, latest

#: Rows that arrived before are early; files have one and a 700th of all rows.
CUT, FILES = "2024-04-10 00:00:00", 700


def with_copies(sales):
    """The rows, and copies of some of them that arrive later."""
    h = F.crc32(F.col("sale_id").cast("string").cast("binary"))
    some = sales.where((h % 3 == 0) & (day_of(sales, "sold_at") % 7 == 0))
    later = lambda name, days: F.col(name) + F.make_dt_interval(days.cast("int"))
    copies = some.withColumns({"total": F.col("total") + 1, "sold_at": later("sold_at", h % 2), "arrived_at": later("arrived_at", 1 + h % 97)})
    return sales.unionByName(copies)


def op12_late_overwrite(spark, sf_dir):
    sales = spark.read.parquet(f"{sf_dir}/sales.parquet")
    per_file = 1 + sales.count() // FILES
    rows = with_copies(sales)
    early = F.coalesce(F.col("arrived_at") < F.expr(f"{'timestamp' if dict(sales.dtypes)['arrived_at'] == 'timestamp' else 'timestamp_ntz'}'{CUT}'"), F.lit(False))
    layout = Layout(sales, new_path(spark, "sales"), "sale_id", "sold_at", "arrived_at", per_file)
    layout.write(latest(rows.where(early), "sale_id", "arrived_at"))
    started = Scratch(spark, "layout").table(layout.files(), "started", narrow=True)
    layout.overwrite(rows.where(~early))
    return layout.digests(started)


QUERIES = {"op12_late_overwrite": op12_late_overwrite}
ORACLES = {}
