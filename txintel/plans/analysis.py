"""The whole analysis of a capture: from two layers to ranked, explained and sealed cases."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from datetime import datetime, timezone
from functools import cache, cached_property

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txintel.functions.expressions import SEVERITIES, category_label, severity
from txintel.operators import cases as C
from txintel.operators import entities as E
from txintel.operators import features as X
from txintel.operators import flow, geo, learn, origin, reports
from txintel.plans.captures import network_table
from txintel.plans.ledger import BIAS, WEIGHTS
from txintel.runtime import checkpoint
from txintel.sources.files import Capture, load

LISTS = {"input_addresses": "array<string>", "output_addresses": "array<string>", "input_amounts": "array<double>", "output_amounts": "array<double>"}


LEADS, DRIVERS = 25, 4
SEEN = 0.01
VERSION = "1.0"
#: How seals write JSON.
JSON = {"ignoreNullFields": "false"}
#: What every lead and case says about itself.
NOTES = "A lead made by txintel from traffic metadata. Where a transaction came from is a statistical estimate and its risk the output of a model: both say where to look next, and neither is evidence until something else confirms it."


@dataclass
class Settings:
    """What an analysis can be given: a fusion model, an origin calibration, a network table, a trained graph network and the means
    of the evidence that explanations start from (those of the capture where there are none)."""

    weights: dict[str, float] = field(default_factory=lambda: dict(WEIGHTS))
    bias: float = BIAS
    calibration: tuple[float, list[float]] | None = None
    networks: DataFrame | None = None
    graph_net: learn.GraphNet | None = None
    means: dict[str, float] | None = None

    def digest(self) -> str:
        """SHA-256 over all that is learned: equal for equal models, however they were made or read."""
        whole = hashlib.sha256(json.dumps([self.weights, self.bias, self.calibration, self.means], sort_keys=True).encode())
        for name, cells in sorted(learn.net_arrays(self.graph_net).items()) if self.graph_net else ():
            whole.update(name.encode() + np.ascontiguousarray(cells, np.float64).tobytes())
        return whole.hexdigest()


class Prepared:
    """A capture correlated and located, before any model; what is linked from it is worked out, and checkpointed, when it is
    first asked for.

    tx: placed transactions with their origins; rows: (id, x) features. part: for several captures in one (plans.stacking), the
    number of a transaction's capture and its own name there, from txid.
    """

    def __init__(self, observations: DataFrame, transactions: DataFrame, attributed: DataFrame, tx: DataFrame, part: tuple[Column, Column] | None = None):
        self.observations, self.transactions, self.attributed, self.tx, self.part = observations, transactions, attributed, tx, part

    @cached_property
    def inputs(self) -> DataFrame:
        return flow.inputs(self.tx)

    @cached_property
    def outputs(self) -> DataFrame:
        return flow.outputs(self.tx)

    @cached_property
    def links(self) -> DataFrame:
        return checkpoint(flow.spend_links(self.inputs, self.outputs, times=True))

    @cached_property
    def edges(self) -> DataFrame:
        return checkpoint(flow.flow_edges(self.links))

    @cached_property
    def entities(self) -> DataFrame:
        return checkpoint(E.entities(self.inputs, self.tx.filter(F.col("coinjoin") >= E.MIXED)))

    @cached_property
    def chain_steps(self) -> DataFrame:
        return checkpoint(E.chains(E.remainder_hops(self.tx, self.links, E.peel_shaped()), self.tx))

    @cached_property
    def chains(self) -> DataFrame:
        return checkpoint(E.chain_table(self.chain_steps, self.tx))

    @cached_property
    def delays(self) -> DataFrame:
        return checkpoint(flow.link_delays(self.tx, self.links))

    @cached_property
    def features(self) -> DataFrame:
        return checkpoint(X.tx_features(self.tx, flow.degrees(self.edges), self.delays))

    @property
    def rows(self) -> DataFrame:
        return self.features.select(F.col("txid").alias("id"), F.array(*X.FEATURES).alias("x"))

    @property
    def graph(self) -> DataFrame:
        return self.edges.select(F.col("parent").alias("src"), F.col("child").alias("dst"))


@dataclass
class Result:
    """Tables by name, all DataFrames; see analyse. Each is worked out when it is first asked for. parts: what documents are made
    of, see cases.documents."""

    tables: dict[str, Callable[[], DataFrame]]
    parts: Callable[[], dict[str, C.Part]]
    found: dict[str, DataFrame] = field(default_factory=dict)

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.found:
            self.found[name] = self.tables[name]()
        return self.found[name]


def prepare(spark: SparkSession, capture: Capture, networks: DataFrame | None = None, calibration: tuple[float, list[float]] | None = None, locate: Column | None = None, attributed: DataFrame | None = None, part: tuple[Column, Column] | None = None) -> Prepared:
    """Correlates both layers and locates origins. locate: the address of an origin_ip that is none; attributed: the attribution
    of the observations where it is there already, rated by the calibration here."""
    obs = checkpoint(capture.observations) if attributed is None and not capture.columnar else capture.observations
    rated = origin.attribute(obs, calibration) if attributed is None else origin.rated_by(attributed, calibration)
    placed = rated.withColumn("address", locate if locate is not None else F.col("origin_ip"))
    located = geo.enrich(placed, geo.networks(networks if networks is not None else network_table(spark)), "address")
    known = capture.transactions
    sided = known.withColumns({n: F.coalesce(n, F.array().cast(known.schema[n].dataType)) for n in LISTS})
    joined = sided.drop("ts").join(located, "txid").withColumn("ts", F.col("first_ts"))  # what nobody announced has no time
    category = F.when(F.col("resolved"), F.col("category")).otherwise("unresolved")
    tx = checkpoint(joined.withColumns({"origin_category": category, "coinjoin": E.coinjoin_score()}))
    return Prepared(obs, known, placed, tx, part)


def anomalies(p: Prepared) -> DataFrame:
    """(id, anomaly) by an isolation forest of each capture."""
    if p.part is None:
        return learn.isolation_scores(p.rows, *learn.fit_isolation_forest(p.rows))
    part, name = p.part
    rows = p.features.select("txid", F.array(*X.FEATURES).alias("x"), part.cast("int").alias("part"), name.alias("name"))
    forests = learn.fit_isolation_forests(rows.select(F.col("name").alias("id"), "x", "part"))
    return learn.part_scores(rows.select(F.col("txid").alias("id"), "x", "part"), forests)


def evidence(p: Prepared, net: learn.GraphNet | None = None, anomaly: bool = True) -> DataFrame:
    """tx with the ten signals, for the caller to checkpoint with what it adds. Without a network gnn_prob is 0; without anomaly,
    that is."""
    hops = p.chain_steps.groupBy("txid").agg(F.max_by("hops", F.struct("start_ts", "start")).alias("peel_hops"))
    burst = reports.origin_burst(p.tx.select("txid", "ts", F.col("origin_ip").alias("ip"))).select("txid", "burst")
    full = p.tx.join(hops, "txid", "left").join(p.delays, "txid").join(burst, "txid").fillna(0, ["peel_hops"])
    scores = {
        "anomaly": anomalies(p) if anomaly else None,
        "gnn_prob": net.scores(p.rows, p.graph) if net is not None else None,
    }
    for name, found in scores.items():
        full = full.withColumn(name, F.lit(0.0)) if found is None else full.join(found.withColumnRenamed("id", "txid"), "txid")
    return X.evidence(full)


def counters(p: Prepared, risk: DataFrame, cases: DataFrame) -> DataFrame:
    """One row: what the capture holds and what was found in it. Repeated inputs and outputs are edges each."""
    one = lambda df, name: df.agg(F.count("*").alias(name))
    if_ = lambda c, name: F.count(F.when(c, 1)).alias(name)
    sides = F.size("input_addresses") + F.least(F.size("output_addresses"), F.size("output_amounts"))
    tx = p.tx.agg(
        F.count("*").alias("transactions"), if_(F.col("resolved"), "origin_attributed"), if_(~F.col("resolved"), "origin_unresolved"), if_(F.col("coinjoin") >= E.MIXED, "coinjoin_transactions"),
        F.min("ts").alias("capture_start"), F.max("ts").alias("capture_end"), (F.count("*") + F.coalesce(F.sum(sides), F.lit(0))).alias("graph_edges"), F.count_distinct("origin_ip").alias("origin_ips"),
    )
    seen = p.observations.groupBy("txid").agg(F.count("*").alias("seen"))
    both = seen.join(p.transactions.select("txid", F.lit(True).alias("known")), "txid", "full").agg(
        F.coalesce(F.sum("seen"), F.lit(0)).alias("observations"), F.count("seen").alias("observed_txids"), if_(F.col("seen").isNull(), "unobserved_transactions"),
        F.coalesce(F.sum(F.when(F.col("known").isNull(), F.col("seen"))), F.lit(0)).alias("uncorrelated_observations"),
    )
    wallets = p.tx.select(F.explode(F.concat("input_addresses", F.slice("output_addresses", F.lit(1), F.greatest(F.least(F.size("output_addresses"), F.size("output_amounts")), F.lit(0))))).alias("a")).distinct()
    parts = [
        tx, both, one(wallets, "wallet_addresses"), one(p.edges, "flow_edges"), one(p.entities.select("entity").distinct(), "entities"), one(p.chains, "peel_chains"),
        risk.agg(if_(F.col("risk") >= C.FLAGGED, "flagged_transactions")), one(cases, "cases"),
    ]
    out = parts[0]
    for x in parts[1:]:  # one row each
        out = out.crossJoin(F.broadcast(x))
    return out.withColumn("graph_nodes", F.col("transactions") + F.col("wallet_addresses") + F.col("origin_ips"))


def case_table(p: Prepared, scored: DataFrame, member: DataFrame) -> DataFrame:
    value = F.aggregate("input_amounts", F.lit(0.0), lambda a, x: a + x)
    plain = scored.select("txid", "ts", "risk", value.alias("inflow"), F.size("output_addresses").alias("n_out"), F.array_min("output_amounts").alias("least_out"), "coinjoin", "peel_hops")
    return checkpoint(C.case_table(member, plain, p.links))


def case_parts(p: Prepared, shap: DataFrame, member: DataFrame, weights: dict[str, float], drops: DataFrame | None) -> dict[str, C.Part]:
    """The tables behind the arrays of cases' documents, with their order and fields. shap: scored with mean_ and shap_ columns."""
    value = F.aggregate("input_amounts", F.lit(0.0), lambda a, x: a + x)
    names = list(weights)
    core = member.filter("core").select("txid", "case_root")
    means = shap.join(core, "txid").groupBy("case_root").agg(*(F.avg(n).alias(n) for n in names), *(F.avg(f"shap_{n}").alias(f"shap_{n}") for n in names))
    factors = means.select("case_root", F.posexplode(X.factors(names)).alias("place", "f")).select("case_root", "place", "f.*")
    flows, terminals = C.case_flow(member, p.links), checkpoint(C.terminals(member, p.outputs, p.links))
    owned = p.inputs.join(member.select("txid", "case_root"), "txid").join(p.entities, "address").select("case_root", "entity_id", "size").distinct()
    rows = shap.join(member, "txid").select(
        "case_root", "txid", "ts", F.round("risk", 1).alias("risk_score"), severity("risk").alias("severity"), (~F.col("core")).alias("bridge"), F.size("input_addresses").alias("inputs"), F.size("output_addresses").alias("outputs"),
        F.round(value, 8).alias("value"), "fee", "origin_ip", F.col("confidence").alias("origin_confidence"), F.col("lead_ms").alias("origin_lead_ms"), F.col("country").alias("origin_country"), F.col("category").alias("origin_category"),
        F.round("gnn_prob", 4).alias("gnn_prob"), F.round("anomaly", 4).alias("anomaly"), F.array(*(F.round(n, 3) for n in names)).alias("evidence"), F.array(*(F.round(f"shap_{n}", 3) for n in names)).alias("shap"),
    )
    parts = {
        "origins": (checkpoint(C.origins(member, p.tx)), [~F.col("resolved"), -F.col("transactions"), F.col("ip")], ["ip", "transactions", "country", "asn", "org", "category", "category_label", "mean_confidence", "resolved"]),
        "entities": (owned, [F.col("entity_id")], ["entity_id", "size"]),
        "terminal_outputs": (terminals, [F.col("place")], ["address", "amount", "status"]),
        "factors": (factors, [F.col("place")], ["key", "label", "value", "shap", "share_pct", "impact"]),
        "transactions": (rows, [F.col("ts"), F.col("txid")], [c for c in rows.columns if c != "case_root"]),
        "edges": (flows, [F.col("parent"), F.col("child")], ["parent", "child", "amount"]),
    }
    if drops is not None:
        mean = drops.join(core, drops.id == core.txid).groupBy("case_root", "feature").agg(F.round(F.avg("drop"), 3).alias("log_odds_drop"))
        turn = F.row_number().over(C.Window.partitionBy("case_root").orderBy(F.desc(F.abs("log_odds_drop")), "feature"))
        named = F.array(*map(F.lit, X.FEATURES))[F.col("feature")]
        top = mean.withColumns({"place": turn, "feature": named, "label": F.create_map(*(F.lit(x) for kv in X.FEATURE_LABELS.items() for x in kv))[named]}).filter(F.col("place") <= DRIVERS)
        parts["gnn_drivers"] = (top, [F.col("place")], ["feature", "label", "log_odds_drop"])
    return parts


def _worded(table: DataFrame, member: DataFrame, parts: dict[str, C.Part], base: float, names: Iterable[str], most: int | None = None) -> DataFrame:
    """Cases with the parts of these names, terminal_output_count, narrative, tags, base value and notes."""
    counts = parts["terminal_outputs"][0].groupBy("case_root").agg(F.first("terminal_outputs").alias("terminal_output_count"))
    told = C.documents(table.join(counts, "case_root", "left").fillna(0, ["terminal_output_count"]), member, {n: parts[n] for n in names}, most)
    facts = told if "origins" in names else told.join(C.origin_facts(parts["origins"][0]), "case_root", "left")
    return facts.withColumns({"narrative": C.narrative(), "typology_tags": F.split("typology", r" \+ "), "base_value_log_odds": F.lit(round(base, 4)), "notes": F.lit(NOTES)}).drop("origin_facts")


def documents(table: DataFrame, member: DataFrame, parts: dict[str, C.Part], base: float, most: int | None = None) -> DataFrame:
    """Cases as documents. table, parts: case_table and case_parts; most: see cases.documents."""
    return sealed(_worded(table, member, parts, base, parts, most))


def summaries(table: DataFrame, member: DataFrame, parts: dict[str, C.Part], base: float) -> DataFrame:
    """Documents without the arrays that grow with a case; cases.sizes and seals say what goes with them."""
    return checkpoint(_worded(table, member, parts, base, [n for n in parts if n in C.BOUNDED]))


def seals(summary: DataFrame, parts: dict[str, C.Part]) -> DataFrame:
    """summary with n_<part>, the rows of each part that grows with a case, and the evidence_hash of the case's document.

    The hash is that of sealed(): a document's JSON is read in pieces, in order, and never is a row, so a case of any size has it.
    """
    grown = {n: p for n, p in parts.items() if n not in C.BOUNDED}
    arrays = sorted(grown)
    names = sorted([*summary.columns, *arrays])
    cuts = [-1, *(names.index(n) for n in arrays), len(names)]
    pieces = []
    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        own, last = names[a + 1 : b], k == len(arrays)
        texts = [F.lit("]" if k else "{")]
        if own:
            json = F.to_json(F.struct(*(_in_order(F.col(n), summary.schema[n].dataType).alias(n) for n in own)), JSON)
            texts += [F.lit("," if k else ""), json.substr(F.lit(2), F.length(json) - 2)]
        texts.append(F.lit("}" if last else ("," if k or own else "") + f'"{arrays[k]}":['))
        pieces.append(F.concat(*texts))
    heads = summary.select("case_root", F.posexplode(F.array(*pieces)).alias("n", "piece")).withColumn("n", F.col("n") * 2)
    kind = summary.schema["case_root"].dataType.simpleString()
    schema = f"case_root {kind}, evidence_hash string, {', '.join(f'n_{n} int' for n in arrays)}"
    found = C.told(heads, [(2 * k + 1, grown[n]) for k, n in enumerate(arrays)], lambda x, kind: F.to_json(_in_order(x, kind), JSON), _digests(arrays), schema)
    return summary.join(found, "case_root")


def _digests(arrays: list[str]) -> Callable[[Iterator], Iterator]:
    """For cases.told: (case_root, evidence_hash, rows of each array) of pieces of JSON; those at odd n are an array's elements."""

    def fold(batches: Iterator) -> Iterator:
        import pyarrow as pa

        case, whole, last, sizes, done = None, None, None, None, []
        for batch in batches:
            kinds = [batch.schema.field(0).type, pa.string(), *[pa.int32()] * len(arrays)]
            names = ["case_root", "evidence_hash", *(f"n_{a}" for a in arrays)]
            for root, n, piece in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if root != case or whole is None:
                    if whole is not None:
                        done.append((case, whole.hexdigest(), *sizes))
                    case, whole, last, sizes = root, hashlib.sha256(), None, [0] * len(arrays)
                if n % 2:
                    sizes[n // 2] += 1
                    if n == last:
                        whole.update(b",")
                whole.update(piece.encode())
                last = n
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names)
                done = []
        if whole is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((case, whole.hexdigest(), *sizes), kinds, strict=True)], names)

    return fold


def analyse(spark: SparkSession, capture: Capture | str | list[str], settings: Settings | None = None, anomaly: bool = True, locate: Column | None = None) -> Result:
    """Correlates, enriches, links, scores and groups a capture (or the files of one).

    stats, sources, transactions (with evidence, risk, contributions and factors), cases (documents), case_* (what their arrays
    hold), case_summaries (documents without arrays that grow), case_sizes (these with such arrays' sizes), case_seals (with documents'
    seals too), members, leads (dossiers), origins, timeline, networks, severities, case_severities, typologies,
    stream, entities, chains. Only what is asked for is worked out.
    """
    s = settings or Settings()
    c = capture if isinstance(capture, Capture) else load(spark, capture)
    p = prepare(spark, c, s.networks, s.calibration, locate)
    scored = checkpoint(evidence(p, s.graph_net, anomaly).withColumn("risk", X.risk(s.weights, s.bias)).withColumn("severity", severity("risk")))
    means = cache(lambda: s.means or {n: v or 0.0 for n, v in scored.agg(*(F.avg(n).alias(n) for n in s.weights)).first().asDict().items()})
    base = cache(lambda: s.bias + sum(means()[n] * w for n, w in s.weights.items()))
    shap = cache(lambda: scored.withColumns(X.shap(s.weights, means())))
    member = cache(lambda: checkpoint(C.members(scored, p.edges)))
    table = cache(lambda: case_table(p, scored, member()))
    drops = cache(lambda: learn.occlusion(s.graph_net, p.rows, p.graph) if s.graph_net is not None else None)
    parts = cache(lambda: case_parts(p, shap(), member(), s.weights, drops()))
    summary = cache(lambda: summaries(table(), member(), parts(), base()))
    explained = cache(lambda: shap().withColumn("factors", X.factors(list(s.weights))))
    value = F.round(F.aggregate("input_amounts", F.lit(0.0), lambda a, x: a + x), 8)
    leading = lambda: explained().orderBy(F.desc("risk"), "txid").limit(LEADS).filter(F.col("risk") >= C.FLAGGED)
    leads = lambda: leading().select(
        "txid", "ts", F.round("risk", 1).alias("risk_score"), "severity", value.alias("value"), "origin_ip", F.col("confidence").alias("origin_confidence"), F.col("country").alias("origin_country"), F.col("asn").alias("origin_asn"),
        F.col("category_label").alias("origin_network"), F.lit(round(base(), 4)).alias("base_value_log_odds"), F.filter("factors", lambda f: F.abs(f["shap"]) >= SEEN).alias("factors"), F.lit(NOTES).alias("notes"),
    )
    ranked = scored.select("txid", "ts", "risk", "severity", F.col("origin_ip").alias("ip"), "country", "asn", "org", "category", "category_label", "confidence")
    label = category_label("origin_category")
    cased = lambda: scored.join(member().select("txid", "case_root"), "txid", "left").join(table().select("case_root", "case_id"), "case_root", "left")
    stream = lambda: cased().select(
        F.col("ts").alias("t"), F.substring(F.col("txid").cast("string"), 1, 12).alias("id"), F.round(value, 4).alias("v"), F.round("risk", 1).alias("r"), label.alias("n"), F.when(F.col("resolved"), F.col("origin_ip")).alias("ip"), F.col("peer_hop_count").alias("o"), F.col("case_id").alias("c"),
    )
    card = cache(lambda: model_card(spark, s, means(), base()))
    by_category = lambda: ranked.drop("category").join(scored.select("txid", F.col("origin_category").alias("category")), "txid")
    names = [*C.PARTS, *(("gnn_drivers",) if s.graph_net is not None else ())]
    return Result({f"case_{n}": lambda n=n: parts()[n][0] for n in names} | {
        "case_table": table, "stats": lambda: counters(p, scored, table()), "sources": lambda: c.sources, "transactions": explained, "cases": lambda: checkpoint(documents(table(), member(), parts(), base())), "case_summaries": summary, "case_sizes": lambda: C.sizes(summary(), {n: x for n, x in parts().items() if n not in C.BOUNDED}), "case_seals": lambda: seals(summary(), parts()), "members": member, "leads": leads,
        "origins": lambda: reports.origin_table(ranked), "timeline": lambda: reports.timeline(ranked), "networks": lambda: reports.networks(by_category()),
        "severities": lambda: reports.severity_counts(ranked), "case_severities": lambda: C.by_severity(table()), "typologies": lambda: C.typologies(table()),
        "stream": stream, "entities": lambda: p.entities, "chains": lambda: p.chains, "timeline_span": lambda: reports.timeline_span(ranked), "meta": lambda: meta(spark, s),
        "model_card": lambda: card()["model_card"], "model": lambda: card()["model"],
    }, parts)


def meta(spark: SparkSession, s: Settings) -> DataFrame:
    """One row: version, time of the analysis, the model's digest and where networks come from."""
    said = [(VERSION, datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ"), s.digest(), s.graph_net is not None, "bundled CIDR table" if s.networks is None else "given CIDR table")]
    return spark.createDataFrame(said, "version string, generated_at string, model_sha256 string, graph_net boolean, geo_source string")


def model_card(spark: SparkSession, s: Settings, means: dict[str, float], base: float) -> dict[str, DataFrame]:
    """model_card: a row a signal with its wordings, weight and background; model: one row with base value, bias, features and
    thresholds."""
    rows = [(n, *X.EVIDENCE.get(n, (n, None)), round(w, 4), round(means[n], 4)) for n, w in s.weights.items()]
    limits = {n.lower(): least for least, n in SEVERITIES}
    one = [(round(base, 4), round(s.bias, 4), list(X.FEATURES), limits["critical"], limits["high"], limits["medium"], E.PEEL_HOPS)]
    return {
        "model_card": spark.createDataFrame(rows, "key string, label string, absent_label string, weight double, background double"),
        "model": spark.createDataFrame(one, "base_value_log_odds double, bias double, tx_features array<string>, critical double, high double, medium double, peel_min_hops int"),
    }


def _in_order(c: Column, kind: T.DataType) -> Column:
    """The value with its structs' fields in order of their names, whatever order they came in."""
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*(_in_order(c[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name))))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _in_order(x, kind.elementType))
    return c


def sealed(rows: DataFrame) -> DataFrame:
    """rows with evidence_hash: SHA-256 of the JSON of all their columns, names in order, nulls written out."""
    fields = sorted(rows.schema.fields, key=lambda f: f.name)
    whole = F.struct(*(_in_order(F.col(f.name), f.dataType).alias(f.name) for f in fields))
    return rows.withColumn("evidence_hash", F.sha2(F.to_json(whole, JSON), 256))


REPORTS = ("meta", "model_card", "model", "timeline_span", "stats", "sources", "cases", "leads", "origins", "timeline", "networks", "severities", "case_severities", "typologies", "stream")


def write(result: Result, folder: str, tables: tuple[str, ...] = REPORTS) -> None:
    """One folder of JSON lines a table, written by the executors."""
    for name in tables:
        result[name].write.mode("overwrite").json(f"{folder}/{name}")
