"""State histories derived from ``events`` and ``orders``, in Spark and in SQL."""

from pyspark.sql import functions as F

# Each event starts a state of its user.  Errors end a state early (a gap follows),
# signups leave it open, views are of zero length, purchases run over into the next.
EVENT_STATES = """
    SELECT event_id, user_id, event_type, value, ts AS begin_geldigheid,
           CASE WHEN event_type = 'view' THEN ts
                WHEN event_type = 'error' THEN ts + INTERVAL 1 MINUTE
                WHEN event_type = 'purchase' THEN ts + INTERVAL 2 DAY
                WHEN event_type = 'click' THEN volgende END AS eind_geldigheid,
           CASE WHEN event_type <> 'error' THEN volgende END AS verval,
           CASE WHEN event_type = 'view' THEN ts END AS einddatum
    FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS volgende FROM events)
"""


def event_states(t):
    from stateweave.operators import history

    e = t.events.withColumn("__open", F.lit(None).cast("timestamp"))
    chained = history.with_next_begin(e, ["user_id"], "ts", "__open", out="volgende")
    kind = F.col("event_type")
    end = (
        F.when(kind == "view", F.col("ts"))
        .when(kind == "error", F.col("ts") + F.expr("INTERVAL 1 MINUTE"))
        .when(kind == "purchase", F.col("ts") + F.expr("INTERVAL 2 DAYS"))
        .when(kind == "click", F.col("volgende"))
    )
    return chained.select(
        "event_id",
        "user_id",
        "event_type",
        "value",
        F.col("ts").alias("begin_geldigheid"),
        end.alias("eind_geldigheid"),
        F.when(kind != "error", F.col("volgende")).alias("verval"),
        F.when(kind == "view", F.col("ts")).alias("einddatum"),
    )
