"""The Parquet dashboard page as one plan: filter once, derive every metric.

source table → prepare → window / type / last-60s filters → KPIs, distributions,
series, journeys, top-k, matrices.  Each metric is its own lazy DataFrame; when more
than one is computed the filtered frame is persisted (memory, spilling to disk), so
the table is scanned once.  Persisted blocks lost with an executor are recomputed
from the Parquet files.  Only bounded results (KPI row, top-k) should be collected.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import timedelta, timezone

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventscope.functions.timefn import duration_us
from eventscope.operators import filters as FL
from eventscope.operators import metrics as M
from eventscope.operators import timeseries as TS
from eventscope.operators.normalize import PREVIEW_COLUMNS, detect_shape, prepare, preview, to_canonical
from eventscope.operators.sinks import csv_ready
from eventscope.sources.files import CORRUPT


@dataclass
class Dashboard:
    """Controls of the dashboard; ``as_of`` defaults to the latest event time.

    ``persist=None`` persists the filtered frame only when a filter narrows it (a
    window, a type selection or the last 60 s): caching an unfiltered table would copy
    all of it, and Spark would also serve that cache to any other query with the same
    plan (without its column pruning).  Call ``release()`` when the page is done.
    """

    window: str = "All"
    event_types: list[str] | None = None
    recent_only: bool = False
    bucket: str = "5s"
    as_of: object = None
    top_k: int = 5
    persist: bool | None = None

    def __post_init__(self):
        self._cached: list[DataFrame] = []

    @classmethod
    def for_table(cls, spark, path: str, merge_schema: bool = False, narrow: bool = False,
                  last_minute: bool = False, **controls):
        """(page, raw events) for a stored table; unless ``as_of`` is given, "now" is
        the latest event time read from the Parquet footers (no column scan).

        For a store (``streaming.store``) "now" comes from its file index, and with ``narrow``
        only the files are opened that the page's window and types can match.
        """
        from eventscope.plans.tables import latest_from_footers
        from eventscope.sources.files import read_event_table
        from eventscope.streaming import store
        if store.is_store(spark, path):
            if controls.get("as_of") is None:
                controls["as_of"] = store.latest_event_time(spark, path)
            page, after = cls(**controls), None
            us = duration_us(page.window)
            if page.recent_only or last_minute:
                us = min(us or 60_000_000, 60_000_000)
            if narrow and us is not None and hasattr(page.as_of, "year"):
                after = page.as_of - timedelta(microseconds=us)
            types = page.event_types if narrow else None
            return page, store.read_store(spark, path, after=after, types=types).drop(CORRUPT)
        raw = read_event_table(spark, path, merge_schema)
        if controls.get("as_of") is None:
            controls["as_of"] = latest_from_footers(spark, path)
        return cls(**controls), raw

    def _narrowing(self) -> bool:
        return (self.window not in (None, "All")) or self.event_types is not None or self.recent_only

    def events(self, raw: DataFrame) -> DataFrame:
        """Prepared events of any known shape: older ones are mapped first, so that the
        user of a ``user_id`` table is the key; a flat category column is kept."""
        if detect_shape(raw) != "v2":
            raw = to_canonical(raw, keep=["row_id", "product_category"])
        return prepare(raw)

    def anchor(self, events: DataFrame):
        """"Now", or None when no event has a valid time (then no window narrows)."""
        latest = FL.latest_ts_value(events) if self.as_of is None or self._narrowing() else None
        return None if latest is None else self.as_of if self.as_of is not None else latest

    def scan(self, raw: DataFrame, now, recent_only: bool = False) -> DataFrame:
        """``raw``, with the window as a bound on the stored epoch seconds where the table
        has no ``ts`` column: a derived time reaches no scan, a stored number does.  The
        bound is a second wide of the exact filter that follows."""
        us = duration_us(self.window)
        if recent_only:
            us = min(us or 60_000_000, 60_000_000)
        if now is None or us is None or not hasattr(now, "year") or "ts" in raw.columns or \
                not isinstance(dict((f.name, f.dataType) for f in raw.schema.fields).get("timestamp"), T.DoubleType):
            return raw
        if now.tzinfo is None:
            now = now.replace(tzinfo=timezone.utc)
        return raw.where(F.col("timestamp") > F.lit(now.timestamp() - us / 1e6 - 1.0))

    def filtered(self, raw: DataFrame) -> DataFrame:
        now = self.anchor(self.events(raw))
        events = self.events(self.scan(raw, now, self.recent_only))
        out = FL.dashboard_filters(events, self.window, self.event_types, self.recent_only, now)
        if self.persist or (self.persist is None and self._narrowing()):
            out = out.persist(StorageLevel.MEMORY_AND_DISK)
            self._cached.append(out)
        return out

    def release(self) -> None:
        """Drop the persisted filtered frames."""
        for df in self._cached:
            df.unpersist()
        self._cached.clear()

    def metrics(self, raw: DataFrame) -> dict[str, DataFrame]:
        """Every chart of the page, as lazy DataFrames over one filtered frame."""
        f = self.filtered(raw)
        b = self.bucket
        return {
            "kpis": M.kpis(f),
            "data_status": M.data_status(f, source_columns=len(raw.columns)),
            "preview": preview(f, 100, PREVIEW_COLUMNS),
            "download": csv_ready(f),
            "event_type_distribution": M.ranked(M.event_type_counts(f), "event_type"),
            "category_distribution": M.ranked(M.category_counts(f), "category"),
            "events_over_time": TS.dense_counts(f, b),
            "top_categories_over_time": TS.top_categories_over_time(f, b, self.top_k),
            "journey_funnel": M.ranked(M.journey_funnel(f), "journey_type"),
            "top_ids": M.top_ids(f, self.top_k),
            "category_event_matrix": M.category_matrix(f),
            "event_types_over_time": TS.event_types_over_time(f, b),
            "source_columns": raw.sparkSession.createDataFrame(
                [(i, c) for i, c in enumerate(raw.columns)], "position int, column string"),
        }

    # ---- the other dashboard pages, as presets over the same filtered frame ----------

    def json_page(self, raw: DataFrame) -> dict[str, DataFrame]:
        """The JSON-log page: 'Unknown' categories, 1 s dense series, 5 s top
        categories, first-category heatmap, event types zero-filled per 5 s."""
        events = self.events(raw)
        now = self.anchor(events)
        f = FL.dashboard_filters(events, self.window, self.event_types, False, now)
        if self.persist or (self.persist is None and self._narrowing()):
            f = f.persist(StorageLevel.MEMORY_AND_DISK)
            self._cached.append(f)
        # "last 60 s" narrows the additional charts only; the status counts the window
        # before the type selection
        recent = FL.recent(f, 60, now) if self.recent_only else f
        return {
            "kpis": M.kpis(f).select("total_events", "unique_event_types", "total_products"),
            "data_status": M.data_status(FL.time_window(events, self.window, now), "All",
                                         source_columns=len(raw.columns))
            .withColumn("time_window", F.lit(self.window or "All")),
            "event_type_distribution": M.ranked(M.event_type_counts(f), "event_type"),
            "category_distribution": M.ranked(M.category_counts(f, "unknown"), "category"),
            "events_per_second": TS.dense_counts(f, "1s"),
            "top_categories_over_time": TS.keyed_counts(
                FL.in_top_k(f.select("ts", F.explode("categories_unknown").alias("category")),
                            "category", self.top_k), "category", "5s"),
            "journey_funnel": M.ranked(M.journey_funnel(recent), "journey_type"),
            "top_ids": M.top_ids(recent, self.top_k),
            "category_event_matrix": M.first_category_matrix(recent),
            "event_types_over_time": TS.event_types_over_time_filled(recent, "5s"),
        }

    def scan_page(self, raw: DataFrame) -> dict[str, DataFrame]:
        """The Spark-scan page: case-folded journeys, scalar-category share and wide
        heatmap, 5 min series, 15 min wide series shown only with > 1 bucket."""
        f = self.filtered(raw)
        events = self.events(raw)
        as_of = self.anchor(events)
        types_wide = TS.event_types_over_time_wide(f, "15min")
        cats = TS.categories_over_time_filled(f, "15min")
        return {
            # total events of the source and events inside the window
            "data_status": M.data_status(events, self.window, as_of, source_columns=len(raw.columns)),
            "journey_funnel": M.ranked(M.journey_funnel(f, fold_case=True), "journey_type"),
            "event_frequency": M.ranked(M.event_type_counts(f), "event_type"),
            "category_share": M.share_of_total(M.scalar_category_counts(f)),
            "events_over_time": TS.dense_counts(f, "5min"),
            "top_ids": M.top_ids(f, self.top_k),
            "category_event_matrix": M.scalar_category_matrix(f),
            "event_types_over_time": TS.gated(types_wide, 2, basis=f, bucket="15min", key="event_type"),
            "categories_over_time": TS.gated(cats, 2, basis=M.flat_category(f), bucket="15min",
                                             key="product_category"),
        }

    def last_minute_page(self, raw: DataFrame) -> dict[str, DataFrame]:
        """The last-60-seconds page: every chart over the last minute, 500 ms series."""
        page = Dashboard(window="All", event_types=self.event_types, recent_only=True,
                         as_of=self.as_of, top_k=self.top_k, persist=self.persist)
        f = page.filtered(raw)
        self._cached.extend(page._cached)
        return {
            "journey_funnel": M.ranked(M.journey_funnel(f, fold_case=True), "journey_type"),
            "event_frequency": M.ranked(M.event_type_counts(f), "event_type"),
            "category_share": M.share_of_total(M.scalar_category_counts(f)),
            "events_per_half_second": TS.dense_counts(f, "500ms", count_col="event_id"),
            "top_ids": M.top_ids(f, self.top_k),
            "category_event_matrix": M.scalar_category_matrix(f),
            "event_types_over_time": TS.gated(TS.event_types_over_time_filled(f, "5s"), 2),
            "categories_over_time": TS.gated(TS.categories_over_time_filled(f, "5s"), 2),
        }
