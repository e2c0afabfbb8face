"""Training and scoring with the whole ad-log spec, whose ids are too many for a broadcast.

The event stream stands in for the log: each used field is a number of an event, taken into the field's range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.operators import ftrl, sparse
from clickloom.queries.base import LOG, bucket_sql, impressions, md5_sql, query, rounded
from clickloom.queries.models import _ftrl_step_sql
from clickloom.session import staged
from clickloom.spec import Continuous, HashBucket, Vocab
from clickloom.spec.ads import ads_spec

SPEC = ads_spec()
START = "2024-01-01"

# Fields that tell of the moment; of the others these tell of the person, and the rest of the item shown.
MOMENT = {"hour": "hour", "rk_hour": "hour", "weekdays": "days % 7", "day": "month_day - 1", "isweekend": "(days % 7) DIV 5"}
PERSON = {
    "province_id", "city_id", "ip_original", "app_version", "u", "device_model", "user_cates", "user_industrys", "ucomp",
    "os", "device_type", "client_type", "network", "location", "isp", "ugender", "rk_age_range", "longitude", "latitude", "age",
}


def _number(feature, place: int) -> str:
    """A number from 0 to below the feature's size or range, in words that both engines read."""
    if feature.name in MOMENT:
        return MOMENT[feature.name]
    source = "person" if feature.name in PERSON else "item"
    if isinstance(feature, Continuous):
        low, high = map(int, feature.params)
        return f"{low} + ({source} * {place}) % {high - low}"
    return f"({source} * {place} + {place}) % {feature.size}"


NUMBERS = {f.name: _number(f, place) for place, f in enumerate(SPEC.features, 1)}


def _field(feature) -> Column:
    number = F.expr(NUMBERS[feature.name])
    if isinstance(feature, HashBucket):
        return number.cast("string")
    if isinstance(feature, Vocab):
        return F.get(F.array(*map(F.lit, feature.values)), number.cast("int"))
    return number.cast(SPEC.field_type(feature.name))


def ad_log(spark, sf_dir: str) -> DataFrame:
    """One row per event with a click label and the 39 used fields of the spec."""
    days = F.datediff("day", F.lit(START).cast("date"))
    events = impressions(spark, sf_dir).select(
        "event_id", "clk", F.col("user_id").cast("long").alias("person"), F.col("k").cast("long").alias("item"),
        "hour", days.alias("days"), F.dayofmonth("day").alias("month_day"),
    )
    return events.select("event_id", "clk", *[_field(f).alias(f.name) for f in SPEC.features])


def _ids_sql() -> str:
    """Common table expressions: the used fields as text (v_) and as numbers (i_), and one row per event and id."""
    values, own, offsets = [], [], {s.name: s.offset for s in SPEC.wide_slots()}
    for f in SPEC.features:
        number = NUMBERS[f.name].replace(" DIV ", " // ")
        if isinstance(f, Continuous):
            number = bucket_sql(f"({number})", f.boundaries)
        text = f"[{', '.join(repr(v) for v in f.values)}][CAST({number} AS BIGINT) + 1]" if isinstance(f, Vocab) else number
        values += [f"{number} AS i_{f.name}", f"CAST({text} AS VARCHAR) AS v_{f.name}"]
        number = f"{md5_sql(f'v_{f.name}')} % {f.size}" if isinstance(f, HashBucket) else f"CAST(i_{f.name} AS BIGINT)"
        own.append(f"{number} + {offsets[f.name]}")
    for cross in SPEC.crosses:
        joined = " || chr(1) || ".join(f"v_{m}" for m in cross.members)
        own.append(f"{md5_sql(joined)} % {cross.size} + {offsets[cross.name]}")
    return f"""moments AS (SELECT event_id, clk, CAST(user_id AS BIGINT) AS person, CAST(k AS BIGINT) AS item, hour,
      datediff('day', DATE '{START}', day) AS days, dayofmonth(day) AS month_day FROM log),
    fields AS (SELECT event_id, clk, {', '.join(values)} FROM moments),
    pairs AS (SELECT event_id, clk, unnest([{', '.join(own)}]) AS idx FROM fields UNION ALL SELECT event_id, clk, -1 FROM log),
    s0 AS (SELECT DISTINCT idx, 0.0::DOUBLE AS z, 0.1::DOUBLE AS n, 0.0::DOUBLE AS w FROM pairs)"""


@query(
    "ads_train",
    f"""WITH {LOG}, {_ids_sql()}, {_ftrl_step_sql(1)}, {_ftrl_step_sql(2)}
    SELECT event_id, round(sum(w), 6) + 0.0 AS logit FROM pairs JOIN s2 USING (idx) GROUP BY event_id""",
)
def ads_train(spark, sf_dir):
    """Two steps over all columns and crosses of the spec, and the logits under the weights they leave."""
    log = sparse.with_wide_ids(ad_log(spark, sf_dir), SPEC, "md5", "_ids")
    data = staged(ftrl.examples(log, "event_id", F.col("clk"), F.col("_ids")), "ads")  # read by training and scoring
    most = SPEC.wide_dimension + 1
    state = ftrl.train(data, steps=2, max_ids=most)
    # The spec's dimension proves no bound here: ids meet their weights in a salted join.
    scored = ftrl.score(data, state, most, [], tasks=ftrl.tasks_for(data))
    return scored.select(F.col("id").alias("event_id"), rounded(F.col("logit"), 6).alias("logit"))
