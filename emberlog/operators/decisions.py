"""Decisions on access events: policy, behaviour and graph risks, their fusion, and an action."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .features import auc_ap
from .tables import saved, small


@dataclass(frozen=True)
class DecisionConfig:
    alpha: float = 0.45
    beta: float = 0.30
    gamma: float = 0.10
    delta: float = 0.15
    suspicion_decay: float = 0.85
    risk_decay: float = 0.90
    baseline_decay: float = 0.97
    history: int = 50
    entropy_window: int = 20
    entropy_shift: float = 0.35
    context_shift: float = 0.30
    graph_novelty: float = 0.45
    shadow_min: float = 0.25
    shadow_max: float = 0.45
    step_up: float = 0.30
    queue_review: float = 0.50
    human_review: float = 0.70
    high_criticality: float = 0.80

    def __post_init__(self):
        if not math.isclose(self.alpha + self.beta + self.gamma + self.delta, 1.0, abs_tol=1e-9):
            raise ValueError("fusion weights have to sum to 1")


@dataclass(frozen=True)
class Policy:
    """Tables of a policy: (role, action), (role, resource) where * allows all, and lists. A table is broadcast if it was counted
    and is small, else joined as any other."""

    role_actions: DataFrame
    role_resources: DataFrame
    frozen: tuple[str, ...] = ()
    needs_approval: tuple[str, ...] = ()
    approvals: tuple[str, ...] = ()
    delegations: tuple[str, ...] = ()


def with_defaults(events: DataFrame) -> DataFrame:
    """Optional columns as nulls; the mission state is normal."""
    for c in ("approval_id", "delegation_id", "device_id", "source_ip", "mission_state"):
        if c not in events.columns:
            events = events.withColumn(c, F.lit(None).cast("string"))
    return events.withColumn("mission_state", F.coalesce(F.lower("mission_state"), F.lit("normal")))


def policy_risk(events: DataFrame, policy: Policy) -> DataFrame:
    """Adds semantic_risk and policy_reasons (array of codes)."""
    actions, resources = saved(policy.role_actions.select("role", "action").distinct(), "role-actions"), saved(policy.role_resources.select("role", "resource").distinct(), "role-resources")
    a, r = small(actions.withColumn("_ra", F.lit(True))), small(resources.withColumn("_rr", F.lit(True)))
    known, every = small(actions.select("role").distinct().withColumn("_known", F.lit(True))), small(resources.filter("resource = '*'").select("role").withColumn("_all", F.lit(True)))
    e = with_defaults(events).join(a, ["role", "action"], "left").join(r, ["role", "resource"], "left").join(known, "role", "left").join(every, "role", "left")
    rules = (
        ("role_unknown", 0.25, F.col("_known").isNull()),
        ("role_action_mismatch", 0.35, F.col("_ra").isNull()),
        ("resource_scope_mismatch", 0.30, F.col("_all").isNull() & F.col("_rr").isNull()),
        ("resource_frozen", 0.55, F.col("resource").isin(*policy.frozen) if policy.frozen else F.lit(False)),
        ("missing_or_invalid_approval", 0.30, (F.col("action").isin(*policy.needs_approval) & ~F.coalesce(F.col("approval_id").isin(*policy.approvals) if policy.approvals else F.lit(False), F.lit(False))) if policy.needs_approval else F.lit(False)),
        ("invalid_delegation", 0.25, F.coalesce(F.col("delegation_id") != "", F.lit(False)) & ~F.coalesce(F.col("delegation_id").isin(*policy.delegations) if policy.delegations else F.lit(False), F.lit(False))),
        ("mission_state_contradiction", 0.45, (F.col("mission_state") == "freeze") & ~F.col("action").isin("read", "audit", "reverify")),
    )
    risk = F.least(F.lit(1.0), sum((F.when(c, w).otherwise(0.0) for _, w, c in rules), F.lit(0.0)))
    return e.withColumn("semantic_risk", risk).withColumn("policy_reasons", F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, _, c in rules)))).drop("_ra", "_rr", "_known", "_all")


def new_role_actions(events: DataFrame) -> DataFrame:
    """Adds new_role_action: no earlier event of any actor has this role and action. The one memory that actors share, so it is
    taken before events are dealt to actors."""
    first = events.groupBy("role", "action").agg(F.min(F.struct("time", "seq")).alias("_f"))
    return events.join(first, ["role", "action"]).withColumn("new_role_action", F.col("_f") == F.struct("time", "seq")).drop("_f")


@cache
def entropy_term(c: int, n: int) -> float:
    return c / n * math.log2(c / n)


def list_entropy(values: list[str]) -> float:
    n: dict[str, int] = {}
    for v in values:
        n[v] = n.get(v, 0) + 1
    if len(n) < 2:
        return 0.0
    h = -sum([entropy_term(c, len(values)) for c in n.values()])
    return min(1.0, max(0.0, h / math.log2(len(n))))


class Past:
    """What is remembered of an actor, or of an actor in a role at a resource."""

    def __init__(self):
        self.n, self.actions, self.resources, self.baseline = 0, [], [], 0.0

    def entropy(self, action: str | None, resource: str | None, last: int) -> float:
        more = lambda xs, x: (xs[-last:] + [x] if x is not None else xs)[-last:]
        return (list_entropy(more(self.actions, action)) + list_entropy(more(self.resources, resource))) / 2

    def learn(self, action: str, resource: str, c: DecisionConfig, now: float | None = None) -> None:
        """`now` is the entropy with this event, if it was asked for before."""
        for xs, x in ((self.actions, action), (self.resources, resource)):
            xs.append(x)
            del xs[: -c.history]
        self.n += 1
        now = self.entropy(None, None, c.entropy_window) if now is None or action is None or resource is None else now
        self.baseline = now if self.n <= 5 else c.baseline_decay * self.baseline + (1 - c.baseline_decay) * now


class Actor(Past):
    """An actor's memory; kept() and recalled() turn it into a row of ACTORS and back."""

    def __init__(self):
        super().__init__()
        self.roles, self.acts, self.uses, self.devices, self.ips = set(), set(), set(), set(), set()
        self.risk = self.suspicion = 0.0
        self.contexts: dict[tuple[str, str], Past] = {}

    def behaviour(self, e, c: DecisionConfig, asked: dict[int, float] | None = None) -> tuple[float, list[str]]:
        """(risk, reasons); `asked` gets the entropies with this event, for remember()."""
        if self.n == 0:
            return 0.15, ["low_history_actor"]
        parts: list[tuple[str, float]] = []
        parts += [("actor_role_novelty", 0.20)] * (e.role not in self.roles)
        parts += [("actor_action_novelty", 0.20)] * (e.action not in self.acts)
        parts += [("actor_resource_novelty", 0.20 * (0.5 + min(1.0, max(0.0, e.criticality))))] * (e.resource not in self.uses)
        parts += [("new_device", 0.20)] * bool(e.device_id and self.devices and e.device_id not in self.devices)
        parts += [("new_source_ip", 0.15)] * bool(e.source_ip and self.ips and e.source_ip not in self.ips)
        for k, (past, limit, factor, most, name) in enumerate(((self, c.entropy_shift, 0.30, 0.15, "behavioral_entropy_shift"), (self.contexts.get((e.role, e.resource)), c.context_shift, 0.25, 0.12, "context_entropy_shift"))):
            if past and past.n >= 5:
                now = past.entropy(e.action, e.resource, c.entropy_window)
                if asked is not None:
                    asked[k] = now
                shift = max(0.0, now - past.baseline)
                parts += [(name, min(most, factor * shift))] * (shift > limit)
        return min(1.0, sum(w for _, w in parts) + 0.25 * self.risk), [n for n, _ in parts]

    def graph(self, e) -> tuple[float, list[str]]:
        new = 0.35 * (e.resource not in self.uses) + 0.25 * (e.action not in self.acts) + 0.20 * bool(e.new_role_action)
        memory = 0.25 * self.suspicion
        return min(1.0, new + memory), ["graph_novelty"] * (new > 0) + ["graph_suspicion_memory"] * (memory > 0.10)

    def remember(self, e, fused: float, c: DecisionConfig, asked: dict[int, float]) -> None:
        self.roles.add(e.role), self.acts.add(e.action), self.uses.add(e.resource)
        self.devices |= {e.device_id} - {None, ""}
        self.ips |= {e.source_ip} - {None, ""}
        self.learn(e.action, e.resource, c, asked.get(0))
        if (e.role, e.resource) not in self.contexts:
            self.contexts[e.role, e.resource] = Past()
        self.contexts[e.role, e.resource].learn(e.action, e.resource, c, asked.get(1))
        self.risk = min(1.0, c.risk_decay * self.risk + (1 - c.risk_decay) * fused)
        self.suspicion = min(1.0, c.suspicion_decay * self.suspicion + (1 - c.suspicion_decay) * fused)

    def judged(self, e, c: DecisionConfig) -> tuple[float, float, float, float, list[str]]:
        """RISKS of an event, which changes nothing."""
        return self._judged(e, c, None)

    def met(self, e, c: DecisionConfig) -> tuple[float, float, float, float, list[str]]:
        """RISKS of an event, which is then remembered."""
        asked: dict[int, float] = {}
        out = self._judged(e, c, asked)
        self.remember(e, out[3], c, asked)
        return out

    def _judged(self, e, c: DecisionConfig, asked: dict[int, float] | None) -> tuple[float, float, float, float, list[str]]:
        b, why = self.behaviour(e, c, asked)
        g, edges = self.graph(e)
        conf = confidence_of(e.semantic_risk, b, g)
        return b, g, conf, fused_of(e.semantic_risk, b, g, conf, c), [*e.policy_reasons, *why, *edges]

    def kept(self, actor: str) -> tuple:
        own = lambda p: (p.n, p.actions, p.resources, p.baseline)
        contexts = [{"role": r, "resource": x, **dict(zip(("n", "actions", "resources", "baseline"), own(p), strict=True))} for (r, x), p in sorted(self.contexts.items())]
        return (actor, *own(self), *map(sorted, (self.roles, self.acts, self.uses, self.devices, self.ips)), self.risk, self.suspicion, contexts)

    @classmethod
    def recalled(cls, row) -> Actor:
        out = cls()
        for p, x in ((out, row), *((out.contexts.setdefault((c["role"], c["resource"]), Past()), c) for c in row["contexts"])):
            p.n, p.actions, p.resources, p.baseline = int(x["n"]), list(x["actions"]), list(x["resources"]), x["baseline"]
        out.roles, out.acts, out.uses, out.devices, out.ips = (set(row[k]) for k in ("roles", "acts", "uses", "devices", "ips"))
        out.risk, out.suspicion = row["risk"], row["suspicion"]
        return out


PAST = "n long, actions array<string>, resources array<string>, baseline double"
ACTORS = f"actor string, {PAST}, roles array<string>, acts array<string>, uses array<string>, devices array<string>, ips array<string>, risk double, suspicion double, contexts array<struct<role string, resource string, {PAST}>>"


def confidence_of(s: float, b: float, g: float) -> float:
    agree, low, support = 1 - (max(s, b, g) - min(s, b, g)), 1 - max(s, b, g), 1 - abs(s - b)
    return min(1.0, max(0.0, 0.45 * agree + 0.40 * low + 0.15 * support))


def fused_of(s: float, b: float, g: float, conf: float, c: DecisionConfig) -> float:
    return min(1.0, max(0.0, c.alpha * s + c.beta * b + c.gamma * min(s, b) * conf + c.delta * g * conf))


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by keys to as many tasks as shuffles have: the work is in Python, so tasks of few bytes aren't few seconds and must
    not be put together by their bytes."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def with_risks(pdf, out: list[tuple]):
    return pdf.assign(**{n: [o[i] for o in out] for i, n in enumerate(("behavioral_risk", "graph_risk", "confidence", "fusion_risk", "reasons"))})


RISKS = "behavioral_risk double, graph_risk double, confidence double, fusion_risk double, reasons array<string>"


def risks(events: DataFrame, config: DecisionConfig = DecisionConfig()) -> DataFrame:
    """Adds the risks of events (with semantic_risk, policy_reasons, new_role_action), each from its actor's earlier events.

    A fold in order of time, since the fused risk feeds the next one. Rows of an actor lie together, sorted; a task reads them
    batch by batch and holds one actor's memory at a time, however many events one actor has.
    """

    def fold(batches):
        actor, state = None, Actor()
        for pdf in batches:
            out = []
            for e in pdf.itertuples(index=False):
                if e.actor != actor:
                    actor, state = e.actor, Actor()
                out.append(state.met(e, config))
            yield with_risks(pdf, out)

    rows = dealt(events, "actor").sortWithinPartitions("actor", "time", "seq")
    return rows.mapInPandas(fold, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema)}, {RISKS}")


def governed(rows: DataFrame, c: DecisionConfig = DecisionConfig()) -> DataFrame:
    """Adds the action: the first rule of the ladder that applies."""
    has = lambda *n: F.arrays_overlap("reasons", F.array(*map(F.lit, n)))
    s, b, g, f, conf, crit = (F.col(n) for n in ("semantic_risk", "behavioral_risk", "graph_risk", "fusion_risk", "confidence", "criticality"))
    high = crit >= c.high_criticality
    # The order of the rules, and the limits in them.
    out = (
        F.when(has("resource_frozen", "mission_state_contradiction"), F.when((s >= 0.85) | high, "block").otherwise("human_review"))
        .when(has("role_action_mismatch") & (s >= 0.65), "human_review")
        .when(has("resource_scope_mismatch") & high, F.when(s >= 0.45, "human_review").otherwise("queue_review"))
        .when(has("invalid_delegation", "missing_or_invalid_approval"), F.when((s >= 0.60) & (crit >= 0.7), "human_review").otherwise("queue_review"))
        .when(has("new_device", "new_source_ip"), "session_reverify")
        .when(has("actor_role_novelty", "actor_action_novelty"), F.when(f >= c.step_up, "step_up_auth").otherwise("watch"))
        .when((g >= c.graph_novelty) | ((f >= c.shadow_min) & (f < c.shadow_max)), "shadow_observe")
        .when((b >= 0.45) & (s < 0.30), "collect_evidence")
        .when((f >= c.human_review) & (conf <= 0.60), "human_review")
        .when(f >= c.queue_review, "queue_review")
        .when(f >= c.shadow_min, "watch")
        .otherwise("allow")
    )
    return rows.withColumn("action_taken", out)


def decide(events: DataFrame, policy: Policy, config: DecisionConfig = DecisionConfig()) -> DataFrame:
    return governed(risks(new_role_actions(policy_risk(events, policy)), config), config)


@dataclass(frozen=True)
class DecisionState:
    """What decisions remember, as tables: a row for each actor (see ACTORS), and the roles' actions that are known."""

    actors: DataFrame
    role_actions: DataFrame

    def save(self, folder: str) -> None:
        self.actors.write.mode("overwrite").parquet(f"{folder}/actors")
        self.role_actions.write.mode("overwrite").parquet(f"{folder}/role_actions")

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> DecisionState:
        return cls(spark.read.parquet(f"{folder}/actors"), spark.read.parquet(f"{folder}/role_actions"))


def learnt(events: DataFrame, policy: Policy, config: DecisionConfig = DecisionConfig()) -> DecisionState:
    """The state after all these events."""

    def fold(batches):
        import pandas as pd

        names = ["actor", "n", "actions", "resources", "baseline", "roles", "acts", "uses", "devices", "ips", "risk", "suspicion", "contexts"]
        actor, state = None, Actor()
        for pdf in batches:
            out = []
            for e in pdf.itertuples(index=False):
                if e.actor != actor:
                    if actor is not None:
                        out.append(state.kept(actor))
                    actor, state = e.actor, Actor()
                state.met(e, config)
            if out:
                yield pd.DataFrame(out, columns=names)
        if actor is not None:
            yield pd.DataFrame([state.kept(actor)], columns=names)

    rows = dealt(new_role_actions(policy_risk(events, policy)), "actor").sortWithinPartitions("actor", "time", "seq")
    return DecisionState(saved(rows.mapInPandas(fold, ACTORS), "actors"), saved(events.select("role", "action").distinct(), "known-actions"))


#: Events of one actor that are judged together against a frozen state.
STRETCH = 50_000


def frozen_decisions(events: DataFrame, policy: Policy, state: DecisionState, config: DecisionConfig = DecisionConfig(), stretch: int = STRETCH) -> DataFrame:
    """Decisions on events against a state that they don't change: each is judged on its own, so order and batches don't matter.

    Events of an actor are dealt to stretches by a hash, each of which gets the actor's row once, ahead of its events; so memories
    are copied once for `stretch` events, not for each, and an actor with most of the events is many stretches.
    """

    def judge(batches):
        name, actor = None, Actor()
        for pdf in batches:
            own, out = pdf.drop(columns=["_state", "_stretch"]), []
            for e, held in zip(own.itertuples(index=False), pdf["_state"], strict=True):
                if held is not None:
                    name, actor = e.actor, Actor.recalled(held)
                    continue
                if e.actor != name:
                    name, actor = e.actor, Actor()
                out.append(actor.judged(e, config))
            yield with_risks(own[pdf["_state"].isna()], out)

    known = state.role_actions.withColumn("_old", F.lit(True))
    rows = policy_risk(events, policy).join(small(known), ["role", "action"], "left").withColumn("new_role_action", F.col("_old").isNull()).drop("_old")
    sizes = saved(events.groupBy("actor").agg(F.ceil(F.count("*") / stretch).alias("_stretches")), "stretches")
    blank = [(F.lit(0) if isinstance(f.dataType, T.NumericType | T.BooleanType) else F.lit(None)).cast(f.dataType).alias(f.name) for f in rows.schema if f.name != "actor"]
    held = state.actors.withColumn("_state", F.struct(*state.actors.columns)).join(sizes, "actor")
    held = held.withColumn("_stretch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_stretches") - 1))).select("actor", *blank, "_stretch", "_state")
    dealt_out = rows.join(small(sizes), "actor", "left").withColumn("_stretch", F.pmod(F.xxhash64("seq"), F.col("_stretches"))).drop("_stretches")
    both = dealt(dealt_out.unionByName(held, allowMissingColumns=True), "actor", "_stretch").sortWithinPartitions("actor", "_stretch", F.col("_state").isNull())
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return governed(both.mapInPandas(judge, f"{schema}, {RISKS}"), config)


def decision_metrics(decisions: DataFrame) -> DataFrame:
    """(kind, name, n): actions and reasons."""
    a = decisions.groupBy(F.lit("action").alias("kind"), F.col("action_taken").alias("name")).agg(F.count("*").alias("n"))
    return a.union(decisions.select(F.explode("reasons").alias("r")).groupBy(F.lit("reason"), "r").agg(F.count("*")))


def risk_metrics(decisions: DataFrame) -> DataFrame:
    """Events, mean and largest fused risk, mean confidence, and the mean of each risk. Means are of decimals, whose sums are the same
    in any order: a sum of doubles isn't, and a mean that lies between two rounded values then goes up or down by chance."""
    mean = lambda c: F.avg(F.col(c).cast("decimal(20,17)")).cast("double")
    return decisions.agg(F.count("*").alias("events"), mean("fusion_risk").alias("mean_risk"), F.max("fusion_risk").alias("max_risk"), mean("confidence").alias("mean_confidence"), *(mean(f"{c}_risk").alias(f"mean_{c}") for c in ("semantic", "behavioral", "graph")))


def audit(decisions: DataFrame, n: int = 1000) -> DataFrame:
    """The last n decisions, the newest first."""
    return decisions.orderBy(F.desc("time"), F.desc("seq")).limit(n)


#: Sets of actions that governance is measured on.
HARD = ("block", "human_review")
FRICTION = (*HARD, "queue_review", "step_up_auth", "session_reverify")
EVIDENCE = (*FRICTION, "shadow_observe", "collect_evidence", "watch")


def governance(decisions: DataFrame, bad: Column) -> DataFrame:
    """True and false positive rates of hard, friction and evidence actions."""
    rate = lambda acts, of: F.avg(F.when(of, F.col("action_taken").isin(*acts).cast("double")))
    return decisions.agg(*(rate(v, w).alias(f"{k}_{n}") for k, v in (("hard", HARD), ("friction", FRICTION), ("evidence", EVIDENCE)) for n, w in (("tpr", bad), ("fpr", ~bad))))


def risk_aucs(decisions: DataFrame, bad: Column) -> DataFrame:
    """(risk, auc, ap): how well each risk tells bad events from others."""
    out = None
    rows = decisions.withColumn("_bad", bad.cast("int"))
    for name in ("semantic_risk", "behavioral_risk", "graph_risk", "fusion_risk"):
        one = auc_ap(rows.withColumn("_s", F.round(name, 9)), "_s", "_bad").select(F.lit(name).alias("risk"), "auc", "ap")
        out = one if out is None else out.union(one)
    return out


def valid_paths(events: DataFrame, policy: Policy) -> DataFrame:
    """Adds path_valid: actor's role may act, has the resource in scope, and brings the approval and delegation it needs."""
    broken = ("role_unknown", "role_action_mismatch", "resource_scope_mismatch", "missing_or_invalid_approval", "invalid_delegation")
    return policy_risk(events, policy).withColumn("path_valid", ~F.arrays_overlap("policy_reasons", F.array(*map(F.lit, broken))))
