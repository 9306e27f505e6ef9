"""Location-aware event attribution, event collapse and lift against a baseline.

Scope rules are data: an event of a scope applies to a store-day when the dates are equal
and, for local scopes, the store's location column equals the event's ``locale_name``.
National events match on the date alone, so no scope needs a cross product: every rule is
an equi-join against the event side, which the planner broadcasts when its size allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import flag

# Fixed values of the reference's calendar logic.
KEPT_EVENT_TYPES = ["Holiday", "Additional", "Bridge", "Event", "Transfer"]
HOLIDAY_TYPE = "Holiday"
# (scope label = value of `locale`, store column matched against `locale_name`; None = all)
SCOPES = [("National", None), ("Regional", "state"), ("Local", "city")]
SALTS = 16      # parts of the targets of one (date, scope, key)
MIXED_SCOPE = "Mixed"
NO_EVENT = "None"
TYPE_SEPARATOR = ", "
DESCRIPTION_SEPARATOR = " | "


def applicable_events(holidays: DataFrame, kept_types=KEPT_EVENT_TYPES) -> DataFrame:
    """Events that count: kept types, not transferred away (text flag, case-insensitive)."""
    transferred = F.coalesce(F.lower(F.col("transferred")), F.lit("false"))
    return holidays.filter(F.col("type").isin(kept_types) & (transferred != "true"))


def _ckey(c: Column, collation: str | None) -> Column:
    """A location value for comparison: binary by default (as the source's data is stored),
    or under a collation such as 'UNICODE_CI_AI' (case- and accent-insensitive, the way the
    source dialect's default collation compares text)."""
    return F.collate(c, collation) if collation else c


def _scope_key(match_col, collation: str | None = None) -> Column:
    """The value a target row offers to a scope: its location column, or '' for scopes that
    match on the date alone."""
    return _ckey((F.col(match_col) if match_col is not None else F.lit("")).cast("string"), collation)


def attribute_events(events: DataFrame, targets: DataFrame, scopes=SCOPES, date_col: str = "date",
                     keep=("store_nbr",), collation: str | None = None, salts: int = SALTS) -> DataFrame:
    """One row per (target row, applicable event): date, keep..., holiday_scope,
    event_type, description. ``targets`` carries the date and the scope columns.

    One pass over ``targets``: rows on event days (semi join on the event dates) offer one
    (scope, key) pair per scope -- a fixed fan-out of len(scopes) -- and a single equi-join on
    (date, scope, key) against the event side finds every applicable event.

    The event side is broadcast when small. Where it is not, a date that many targets share (its
    National key is one key) would be one task: so targets carry one of ``salts`` salts, by the
    hash of their own columns, and every event is there once for each."""
    salt = F.pmod(F.xxhash64(date_col, *keep), F.lit(salts)).cast("int")
    ev = _copies(_event_keys(events, scopes, collation).select(
        F.col("date").alias("_ev_date"), F.col("locale").alias("_ev_scope"), "_ev_key",
        F.col("type").alias("event_type"), "description"), salts)
    # Most target rows fall on days without any event: keep only event days (a semi join
    # against the calendar-sized set of event dates) before offering the scope keys.
    event_days = _copies(events.filter(F.col("locale").isin([label for label, _ in scopes]))
                         .select(F.col("date").alias("_ev_date")).distinct(), salts)
    targets = targets.withColumn("_salt", salt)
    targets = targets.join(event_days, (targets[date_col] == event_days["_ev_date"])
                           & (targets["_salt"] == event_days["_ev_salt"]), "left_semi")
    keyed = (targets.select(F.col(date_col).alias(date_col), *keep, "_salt",
                            F.explode(_scope_offers(targets, scopes, collation)).alias("_o"))
             .select(date_col, *keep, "_salt", "_o.holiday_scope", "_o._key"))
    cond = ((keyed[date_col] == ev["_ev_date"]) & (keyed["_salt"] == ev["_ev_salt"])
            & (keyed["holiday_scope"] == ev["_ev_scope"]) & (keyed["_key"] == ev["_ev_key"]))
    return keyed.join(ev, cond).select(date_col, *keep, "holiday_scope", "event_type", "description")


def _copies(df: DataFrame, salts: int) -> DataFrame:
    return df.withColumn("_ev_salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))


def _scope_offers(targets: DataFrame, scopes, collation: str | None) -> Column:
    """Per target row: one (holiday_scope, _key) struct per scope, as an array to explode."""
    return F.array(*[F.struct(F.lit(label).alias("holiday_scope"), _scope_key(mc, collation).alias("_key"))
                     for label, mc in scopes])


def _event_keys(events: DataFrame, scopes, collation: str | None) -> DataFrame:
    """Events of the given scopes with their match key ('' for date-only scopes)."""
    labels = [label for label, _ in scopes]
    date_only = [label for label, mc in scopes if mc is None]
    key = F.when(F.col("locale").isin(date_only), F.lit("")).otherwise(F.col("locale_name"))
    return events.filter(F.col("locale").isin(labels)).withColumn("_ev_key", _ckey(key, collation))


def applicable_to_any(events: DataFrame, entities: DataFrame, scopes=SCOPES,
                      collation: str | None = None) -> DataFrame:
    """Events that reach at least one entity: the entities offer their distinct (scope, key)
    pairs (at most scopes x distinct locations), and one semi join keeps the events whose
    (locale, key) is offered. A date-only scope is offered by any entity, so its events are
    kept exactly when the entity table is not empty."""
    offers = (entities.select(F.explode(_scope_offers(entities, scopes, collation)).alias("_o"))
              .select(F.col("_o.holiday_scope").alias("_scope"), F.col("_o._key").alias("_key"))
              .distinct())
    ev = _event_keys(events, scopes, collation)
    cond = (ev["locale"] == offers["_scope"]) & (ev["_ev_key"] == offers["_key"])
    return (ev.join(offers, cond, "left_semi")
            .withColumn("holiday_scope", F.col("locale")).drop("_ev_key"))


def distinct_list(values: Column, sep: str) -> Column:
    """Aggregate: sorted distinct values joined by ``sep`` (no truncation)."""
    return F.array_join(F.array_sort(F.collect_set(values)), sep)


def collapse_events(targets: DataFrame, events: DataFrame, scopes=SCOPES,
                    date_col: str = "date", holiday_type: str = HOLIDAY_TYPE,
                    collation: str | None = None) -> DataFrame:
    """Add is_special_day, is_holiday, holiday_scope, event_type_list and
    event_description_list to every target row (one row out per row in: no fan-out).

    Events are first collapsed per scope key (date, or date + location), which keeps the
    broadcast side as small as the calendar; each target row then picks up at most one
    digest per scope through a left equi-join, and the scopes are merged per row."""
    out = targets
    hits, hols, types, descs = [], [], [], []
    for label, match_col in scopes:
        p = f"_{label.lower()}"
        ev = events.filter(F.col("locale") == label)
        keys = [F.col("date").alias(p + "_date")]
        if match_col is not None:
            keys.append(_ckey(F.col("locale_name"), collation).alias(p + "_loc"))
        dig = ev.groupBy(*keys).agg(
            F.max(F.lit(1)).alias(p + "_hit"),
            F.max(flag(F.col("type") == holiday_type)).alias(p + "_hol"),
            F.collect_set("type").alias(p + "_types"),
            F.collect_set("description").alias(p + "_descs"))
        cond = out[date_col] == dig[p + "_date"]
        if match_col is not None:
            cond = cond & (_ckey(out[match_col], collation) == dig[p + "_loc"])
        out = out.join(dig, cond, "left")
        hits.append((label, F.col(p + "_hit")))
        hols.append(F.col(p + "_hol"))
        types.append(F.coalesce(F.col(p + "_types"), F.array().cast("array<string>")))
        descs.append(F.coalesce(F.col(p + "_descs"), F.array().cast("array<string>")))
        out = out.drop(p + "_date", p + "_loc")

    n_scopes = sum((F.when(h.isNotNull(), 1).otherwise(0) for _, h in hits), F.lit(0))
    scope = F.when(n_scopes > 1, F.lit(MIXED_SCOPE))
    for label, h in hits:
        scope = scope.when(h.isNotNull(), F.lit(label))
    scope = scope.otherwise(F.lit(NO_EVENT))

    def listed(arrays, sep):
        merged = F.array_sort(F.array_distinct(F.concat(*arrays)))
        return F.when(n_scopes > 0, F.array_join(merged, sep)).otherwise(F.lit(NO_EVENT))

    return out.select(
        *[F.col(c) for c in targets.columns],
        flag(n_scopes > 0).alias("is_special_day"),
        F.coalesce(F.greatest(*hols), F.lit(0)).alias("is_holiday"),
        scope.alias("holiday_scope"),
        listed(types, TYPE_SEPARATOR).alias("event_type_list"),
        listed(descs, DESCRIPTION_SEPARATOR).alias("event_description_list"))


def lift_vs_baseline(grouped: DataFrame, is_baseline: Column, measures: dict) -> DataFrame:
    """For a grouped result with a closed, small set of groups (a label vocabulary), take the
    baseline row's measures and add lift columns. ``measures`` maps an input measure column
    to the name of its lift column. Groups with no baseline row give no output, as a join
    with an empty baseline would."""
    everything = Window.partitionBy()   # bounded: one row per label of a closed vocabulary
    out = grouped.withColumns({"_has_base": F.max(flag(is_baseline)).over(everything)}
                              | {"_base_" + m: F.max(F.when(is_baseline, F.col(m))).over(everything)
                                 for m in measures})
    return out.filter(F.col("_has_base") == 1)


def top_events(events: DataFrame, ctx: DataFrame, measures: list, min_days: int = 20,
               collation: str | None = None) -> DataFrame:
    """Per (holiday_scope, event_type, description): affected_store_days (every matched
    store-day, duplicates of the calendar counted again) and the ``measures`` (aggregate
    Columns) over the matched store-days; groups under ``min_days`` are dropped."""
    keep = [c for c in ctx.columns if c not in ("date", "state", "city")]
    pairs = attribute_events(events, ctx, keep=tuple(keep), collation=collation)
    return (pairs.groupBy("holiday_scope", "event_type", "description")
            .agg(F.count(F.lit(1)).alias("affected_store_days"), *measures)
            .filter(F.col("affected_store_days") >= min_days))
