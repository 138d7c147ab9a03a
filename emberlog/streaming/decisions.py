"""Decisions on access events as a stream: memories of actors, and of roles' actions, in the state store."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, StructField, StructType

from emberlog.operators.decisions import RISKS, Actor, DecisionConfig, Policy, governed, policy_risk, with_risks

#: The state store that keyed states need; set it in the session before the stream starts.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def in_order(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """A key's events of one micro-batch, by time and seq."""
    return pd.concat(list(rows), ignore_index=True).sort_values(["time", "seq"], kind="stable", ignore_index=True)


class FirstOfRole(StatefulProcessor):
    """Keyed by role and action: adds new_role_action, true for the first event ever."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "seen boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = in_order(rows)
        known = self.seen.exists()
        self.seen.update((True,))
        yield pdf.assign(new_role_action=[not known and k == 0 for k in range(len(pdf))])

    def close(self) -> None:
        pass


class Judged(StatefulProcessor):
    """Keyed by actor: the risks of each event from the actor's memory, which the event then changes."""

    def __init__(self, config: DecisionConfig):
        self.config = config

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.memory = handle.getValueState("memory", "memory string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf, c = in_order(rows), self.config
        actor = Actor.recalled(json.loads(self.memory.get()[0])) if self.memory.exists() else Actor()
        out = [actor.met(e, c) for e in pdf.itertuples(index=False)]
        names = ("actor", "n", "actions", "resources", "baseline", "roles", "acts", "uses", "devices", "ips", "risk", "suspicion", "contexts")
        self.memory.update((json.dumps(dict(zip(names, actor.kept(str(key[0])), strict=True))),))
        yield with_risks(pdf, out)

    def close(self) -> None:
        pass


def decision_stream(events: DataFrame, policy: Policy, config: DecisionConfig = DecisionConfig()) -> DataFrame:
    """decisions.decide() of a stream whose batches come in order of time: the same decisions for any split into batches.

    Two keyed states, one after the other: which role has done which action before (of any actor), and what is remembered of an
    actor, which grows with what the actor uses and not with its events. The session's state store has to be STATE_STORE.
    """
    rows = policy_risk(events, policy)
    flagged = StructType([*rows.schema.fields, StructField("new_role_action", BooleanType())])
    marked = rows.groupBy("role", "action").transformWithStateInPandas(FirstOfRole(), flagged, "Append", "None")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in flagged)
    judged = marked.groupBy("actor").transformWithStateInPandas(Judged(config), f"{schema}, {RISKS}", "Append", "None")
    return governed(judged, config)


def use_state_store(spark: SparkSession) -> str | None:
    """Sets STATE_STORE in the session and returns what was there, for restore_state_store()."""
    was = spark.conf.get(STATE_STORE[0], None)
    spark.conf.set(*STATE_STORE)
    return was


def restore_state_store(spark: SparkSession, was: str | None) -> None:
    if was is None:
        spark.conf.unset(STATE_STORE[0])
    else:
        spark.conf.set(STATE_STORE[0], was)
