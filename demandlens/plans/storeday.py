"""The store-day analytical layer (the five stacked views) and its materialisation.

metrics   = train -> (date, store) rollup -> stores            (V1)
oil       = oil -> forward fill over existing rows              (V2)
enriched  = metrics + transactions + oil, flags and ratios      (V3)
map       = applicable events -> store-days by scope rules      (V4, store-day grain)
context   = enriched + per-scope event digests, collapsed       (V5)

Plan shape: the fact table is aggregated first (partial + final hash aggregate on
(date, store_nbr)); transactions are joined on the same keys, so the aggregate's hash
partitioning is reused; the dimension-sized sides (stores, the oil calendar, the event
digests) are broadcast when their statistics are under the session's threshold (they are
read from written tables, so the planner knows their size), else shuffle-joined. A written
layer is dealt to its month folders as narrow rows; the calendar's columns are added after that.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.calendar import date_parts, month_start
from ..functions.numeric import pct_rounded_decimal, safe_div
from ..operators.aggregates import entity_day_rollup
from ..operators.events import SCOPES, applicable_events, attribute_events, collapse_events
from ..operators.joins import enrich_with_flag
from ..operators.temporal import forward_fill
from ..session import scratch_path
from ..sources.model import Model, in_months
from ..sources.sink import write_dealt, write_table
from .manifest import MONTH, Manifest, changed_months, fingerprints

METRIC_COLUMNS = ["date", "month_start", "year_num", "month_num", "month_name", "weekday_num",
                  "weekday_name", "is_weekend", "store_nbr", "city", "state", "store_type",
                  "cluster", "total_sales", "total_items_on_promo", "promoted_family_count",
                  "family_rows"]
ENRICHED_COLUMNS = METRIC_COLUMNS + ["transactions", "missing_transactions_flag", "oil_price",
                                     "missing_oil_flag", "promo_family_mix_pct",
                                     "sales_per_transaction"]
LAYER_FILE_ROWS = 2_000_000   # rows of one file of a month's folder (about 200 MB)
CONTEXT_COLUMNS = ENRICHED_COLUMNS + ["is_special_day", "is_holiday", "holiday_scope",
                                      "event_type_list", "event_description_list"]


def store_dimension(stores: DataFrame) -> DataFrame:
    return stores.select("store_nbr", "city", "state", F.col("type").alias("store_type"), "cluster")


def store_day_metrics(train: DataFrame, stores: DataFrame) -> DataFrame:
    """V1: one row per (date, store) of the fact table whose store exists in ``stores``."""
    daily = entity_day_rollup(train, ("date", "store_nbr"), "sales", "onpromotion")
    m = daily.join(store_dimension(stores), "store_nbr")
    return date_parts(m, "date").select(*METRIC_COLUMNS)


def _with_transactions(rows: DataFrame, transactions: DataFrame) -> DataFrame:
    return enrich_with_flag(rows, transactions, ["date", "store_nbr"], "transactions",
                            "transactions", default=0, flag_col="missing_transactions_flag")


def _with_oil(rows: DataFrame, oil_filled: DataFrame) -> DataFrame:
    e = enrich_with_flag(rows, oil_filled, "date", "oil_price_filled", "oil_price",
                         flag_col="missing_oil_flag")
    return e.select(
        *METRIC_COLUMNS, "transactions", "missing_transactions_flag", "oil_price", "missing_oil_flag",
        pct_rounded_decimal("promoted_family_count", "family_rows").alias("promo_family_mix_pct"),
        F.when(F.col("transactions") > 0, safe_div("total_sales", "transactions"))
         .alias("sales_per_transaction"))


def oil_prices_filled(oil: DataFrame) -> DataFrame:
    """V2: last known price carried over the oil calendar's own rows (no rows created)."""
    return forward_fill(oil.select("date", "dcoilwtico"), "dcoilwtico", "date",
                        out="oil_price_filled").select("date", "oil_price_filled")


def store_day_enriched(metrics: DataFrame, transactions: DataFrame, oil_filled: DataFrame) -> DataFrame:
    """V3: transactions (0 + flag when missing), oil (NULL + flag when missing), promo mix
    (exact 2-dp percentage) and sales per transaction (NULL without transactions)."""
    return _with_oil(_with_transactions(metrics, transactions), oil_filled)


def store_day_context(enriched: DataFrame, holidays: DataFrame, collation: str | None = None) -> DataFrame:
    """V5: every enriched store-day plus its collapsed event attributes."""
    return (collapse_events(enriched, applicable_events(holidays), SCOPES, collation=collation)
            .select(*CONTEXT_COLUMNS))


def store_holiday_map(store_days: DataFrame, holidays: DataFrame, collation: str | None = None) -> DataFrame:
    """V4 at store-day grain: one row per (store-day, applicable event), by scope rules."""
    return attribute_events(applicable_events(holidays), store_days, SCOPES, collation=collation)


@dataclass
class Layer:
    """Materialised inputs of the queries: the model tables and the store-day context."""
    spark: SparkSession
    model: Model
    context: DataFrame
    events: DataFrame          # applicable events (small calendar table)
    collation: str | None = None   # how locale names match store locations (None = binary)
    layout: str | None = None      # how the context was written (None: not written)
    manifest: Manifest | None = None    # the valid month folders (layout 'monthly')
    prints: dict | None = None     # fingerprints of the inputs by month, where taken at the build
    _cache: dict = field(default_factory=dict, repr=False)

    def last_date(self):
        """Latest date of the (immutable, written) layer: one scalar, read once."""
        if "last_date" not in self._cache:
            self._cache["last_date"] = self.context.agg(F.max("date").alias("d")).first()["d"]
        return self._cache["last_date"]

    @property
    def stores(self) -> DataFrame:
        return self.model.stores

    @property
    def train(self) -> DataFrame:
        return self.model.train


def materialise_model(model: Model, spark: SparkSession) -> Model:
    """Write each derived model table once (the test binding derives them from raw tables).
    The five writes are independent jobs, submitted together so the small ones overlap."""
    # The facts go to one folder a month (a refresh reads only the months it rebuilds); nothing
    # filters the others by a range.
    train = model.train.withColumn(MONTH, F.trunc("date", "MM"))
    jobs = {"stores": (model.stores, None), "train": (train, MONTH),
            "transactions": (model.transactions, None),
            "holidays_events": (model.holidays, None), "oil": (model.oil, None)}
    with ThreadPoolExecutor(max_workers=len(jobs)) as pool:
        futures = {n: pool.submit(write_table, df, spark, n, (), by) for n, (df, by) in jobs.items()}
        t = {n: f.result() for n, f in futures.items()}
    return Model(stores=t["stores"], train=t["train"].select(*model.train.columns), transactions=t["transactions"],
                 holidays=t["holidays_events"], oil=t["oil"], origin=model.origin,
                 materialise=False, train_by_month=t["train"])


def _layer_rows(model: Model, months=None) -> tuple[dict, int]:
    """A bound of the layer's rows by month: no more than the facts', nor 31 days of every store; and
    the facts' rows in all. The facts' months are counted by task; where they are folders, no column
    is read."""
    facts = model.train_by_month if model.train_by_month is not None else model.train.withColumn(MONTH, F.trunc("date", "MM"))
    if months is not None:
        facts = facts.filter(in_months(F.col(MONTH), months))
    stores = model.stores.agg(F.count(F.lit(1))).scalar()
    rows = facts.groupBy(MONTH).agg(F.count(F.lit(1)).alias("n")).select(MONTH, "n", F.least("n", 31 * stores).alias("most"))
    found = rows.collect()       # a row a month
    return {r[MONTH]: r["most"] for r in found}, sum(r["n"] for r in found)


def _write_months(model: Model, facts: DataFrame, transactions: DataFrame, collation: str | None, folder: str,
                  counts: dict, fact_rows: int, file_rows: int) -> None:
    """Write the context of some months' facts. The rows are dealt to the months' folders while they
    are narrow (the measures and the store's columns); what follows from the calendar - date parts,
    oil, events - is added by the task that writes them."""
    if fact_rows < 2 * sum(counts.values()):
        # hardly two facts a store-day: to add them up before the shuffle would hold a task's whole
        # share of the facts as groups, and make it no smaller
        facts = facts.select("date", "store_nbr", "sales", "onpromotion").repartition("date", "store_nbr")
    daily = _with_transactions(entity_day_rollup(facts, ("date", "store_nbr"), "sales", "onpromotion"), transactions)
    days = daily.join(store_dimension(model.stores), "store_nbr").withColumn(MONTH, month_start("date"))

    def widen(dealt: DataFrame) -> DataFrame:
        enriched = _with_oil(date_parts(dealt, "date"), oil_prices_filled(model.oil))
        return store_day_context(enriched, model.holidays, collation)

    # (date, store_nbr) is unique in the layer: its hash deals a large month evenly, even when one
    # store or one day is hot
    write_dealt(days, facts.sparkSession, folder, MONTH, counts, file_rows, key=("date", "store_nbr"),
                sort_by=("date", "store_nbr"), widen=widen)


def _inputs(model: Model, since=None) -> dict[str, DataFrame]:
    """What a month of the layer is made from, beside the stores; with ``since``, facts from its
    month on."""
    train = model.train
    if since is not None:
        first = F.lit(since.replace(day=1))
        train = (train.filter(F.col("date") >= first) if model.train_by_month is None else
                 model.train_by_month.filter(F.col(MONTH) >= first).select(*train.columns))
    return {"train": train, "transactions": model.transactions, "oil": oil_prices_filled(model.oil),
            "events": applicable_events(model.holidays)}


def refresh_layer(layer: Layer, model: Model, since=None, file_rows: int = LAYER_FILE_ROWS) -> Layer:
    """Incremental refresh after new or corrected inputs: the months in which facts, transactions,
    filled oil prices or applicable events differ from those the layer was built on are written
    anew, from their facts alone; the others are read as they are, and months without facts go.
    A changed store dimension rebuilds everything.

    Differences are found by fingerprints of each input's months (one pass over each, no shuffle
    of rows). With ``since`` (a date) all months from its own on are rebuilt and facts before it
    are taken as unchanged, unread. The layer must have been built with layout='monthly'."""
    if layer.layout != "monthly":
        raise ValueError("refresh_layer needs a layer built with layout='monthly'")
    spark, old = layer.spark, layer.model
    if model.materialise:
        model = materialise_model(model, spark)
    same_stores = (model.stores.exceptAll(old.stores).isEmpty() and old.stores.exceptAll(model.stores).isEmpty())
    if not same_stores:
        return build_layer(model, spark, collation=layer.collation, layout="monthly", file_rows=file_rows,
                           track=layer.prints is not None)
    was, now = layer.prints or fingerprints(_inputs(old, since)), fingerprints(_inputs(model, since))
    first = since.replace(day=1) if since else None
    if first:
        trusted = {k: v for k, v in was.items() if k[0] == "train" and k[1] is not None and k[1] < first}
        now |= trusted
    stale = changed_months(was, now)
    if first:
        stale |= {m for _, m in now if m is not None and m >= first}
    counts, fact_rows = _layer_rows(model, sorted(stale, key=str))
    # a month that only others than its facts name may have facts or not; without, it goes
    live = {m: g for m, g in layer.manifest.months.items() if m not in stale}
    gen = layer.manifest.generation()
    manifest = Manifest(layer.manifest.root, live | {m: gen for m in counts})
    if counts:
        tx = model.transactions.filter(in_months(F.trunc("date", "MM"), list(counts)))
        _write_months(model, model.facts(list(counts)), tx, layer.collation, manifest.folder(gen), counts, fact_rows, file_rows)
    prints = now if layer.prints is not None else None
    return Layer(spark=spark, model=model, context=manifest.read(spark, layer.context.schema),
                 events=applicable_events(model.holidays), collation=layer.collation, layout="monthly",
                 manifest=manifest, prints=prints)


def build_layer(model: Model, spark: SparkSession, materialise: bool = True,
                collation: str | None = None, layout: str = "monthly", file_rows: int = LAYER_FILE_ROWS,
                track: bool = False) -> Layer:
    """Build the store-day layer. ``materialise`` writes the layer (and the model tables, when
    the model says they are derived or parsed from text) under the checkpoint folder.
    ``layout``: 'monthly' (one folder a month: queries over a date window read only its months; a
    month has a file for each ``file_rows`` rows) or 'sorted' (rows sorted by date within files,
    no folders). ``track`` takes the fingerprints that a refresh compares at once, for inputs that
    are read in place and may be overwritten; else the refresh takes them from this model."""
    if layout not in ("monthly", "sorted"):
        raise ValueError(layout)
    if materialise and model.materialise:
        model = materialise_model(model, spark)
    metrics = store_day_metrics(model.train, model.stores)
    enriched = store_day_enriched(metrics, model.transactions, oil_prices_filled(model.oil))
    ctx = store_day_context(enriched, model.holidays, collation)
    manifest = None
    if materialise and layout == "monthly":
        counts, fact_rows = _layer_rows(model)
        manifest = Manifest(scratch_path(spark, "store_day_context"), {m: 0 for m in counts})
        _write_months(model, model.train, model.transactions, collation, manifest.folder(0), counts, fact_rows, file_rows)
        ctx = manifest.read(spark, ctx.schema)
    elif materialise:
        ctx = write_table(ctx, spark, "store_day_context", sort_by=("date", "store_nbr"))
    return Layer(spark=spark, model=model, context=ctx, events=applicable_events(model.holidays),
                 collation=collation, layout=layout if materialise else None, manifest=manifest,
                 prints=fingerprints(_inputs(model)) if track else None)
