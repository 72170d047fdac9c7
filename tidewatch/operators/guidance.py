"""Candidate causes of an anomaly, and the runbooks its description calls for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.text import contains_any, once
from tidewatch.rules import Rules

# Causes to investigate for an anomaly of no known type, most likely first.
GENERIC_CAUSES = [
    "Resource saturation: CPU, memory/heap, or GC pressure on the affected component.",
    "Data-side cause: partition skew, hot keys, or a surge in input volume.",
    "External dependency: a downstream sink, source, or coordination service degrading.",
    "Configuration or deployment change: a recent config, scaling, or version change.",
]

# Causes to investigate per anomaly type, most likely first.
CAUSES = {
    "latency_spike": [
        "GC/heap pressure or long stop-the-world pauses on the TaskManager.",
        "Serialization/deserialization cost or an expensive operator on the hot path.",
        "Latency in an external call (enrichment, sink, or lookup) blocking the pipeline.",
    ],
    "throughput_drop": [
        "A slow or stuck consumer/operator reducing end-to-end throughput.",
        "A partition rebalance or reassignment interrupting consumption.",
        "An upstream volume surge or source slowdown changing input rate.",
    ],
    "backpressure": [
        "Downstream sink saturation (slow writes) propagating backpressure upstream.",
        "Operator skew or a hot key overloading one subtask.",
        "Insufficient parallelism for the current load.",
    ],
    "checkpoint_failure": [
        "State size growth making checkpoints exceed their timeout.",
        "Checkpoint timeout/interval configuration too tight for the workload.",
        "State-backend or durable-storage I/O errors or slowness.",
    ],
    "memory_pressure": [
        "Heap exhaustion or GC thrash from object churn.",
        "Unbounded state growth (missing TTL or retention).",
        "Data skew concentrating memory on one subtask.",
    ],
    "error_burst": [
        "Bad or poison input (malformed events, schema drift) triggering exceptions.",
        "A downstream dependency failing and surfacing as errors.",
        "A recent deploy or config change regressing behavior.",
    ],
}

# Words in a description that call for the runbook of a type, in type order.
RUNBOOK_WORDS = {
    "latency_spike": ["latency", "slow", "delay", "processing time"],
    "checkpoint_failure": ["checkpoint", "savepoint", "state snapshot"],
    "throughput_drop": ["lag", "throughput", "consumer lag", "behind"],
    "backpressure": ["backpressure", "back pressure", "saturated"],
    "error_burst": ["error", "exception", "out of order", "late event"],
}


def candidate_causes(anomaly_type: Column, rules: Rules = Rules()) -> Column:
    """Causes to explore in parallel, at most one per fork; none when there is no forking."""
    if rules.diagnostic_forks <= 1:
        return F.array().cast("array<string>")
    generic = F.array(*[F.lit(c) for c in GENERIC_CAUSES])
    chosen = generic
    if rules.hypothesis_mode == "map":
        for kind, causes in CAUSES.items():
            chosen = F.when(anomaly_type == kind, F.array(*[F.lit(c) for c in causes])).otherwise(chosen)
    return F.slice(chosen, 1, rules.diagnostic_forks)


def hypothesis_plan(anomalies: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row per anomaly and candidate cause; ``fork`` numbers the causes."""
    causes = candidate_causes(F.col("anomaly_type"), rules)
    return anomalies.select("*", F.posexplode(causes).alias("fork", "cause"))


def runbook_types(text: Column) -> Column:
    """Types whose words occur in the text, in type order."""

    def matched(lowered: Column) -> Column:
        kinds = [F.when(contains_any(lowered, words), F.lit(kind)) for kind, words in RUNBOOK_WORDS.items()]
        return F.array_compact(F.array(*kinds))

    return once(F.lower(text), matched)


def match_runbooks(texts: DataFrame, runbooks: DataFrame, text: str = "text") -> DataFrame:
    """Runbook bodies for each text, in type order; types without a runbook are left out.

    Only the listed types can match and ``runbooks`` has one row per type, so
    the broadcast side has at most as many rows as there are listed types.
    """
    known = runbooks.filter(F.col("anomaly_type").isin(*RUNBOOK_WORDS)).select("anomaly_type", "title", "body")
    matched = texts.select("*", F.posexplode(runbook_types(F.col(text))).alias("type_pos", "anomaly_type"))
    return matched.join(F.broadcast(known), "anomaly_type")
