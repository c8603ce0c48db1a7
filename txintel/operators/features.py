"""Transaction features, the evidence behind a risk score, the fused score and its exact explanation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txintel.functions.expressions import same_amounts, sigmoid
from txintel.operators.flow import NEVER_S

FEATURES = ("log_value", "log_inputs", "log_outputs", "log_fee_rate", "output_ratio", "equal_out_frac", "log_respend", "log_next_spend", "log_in_degree", "log_out_degree")
# What the features are called in reports.
FEATURE_LABELS = {
    "log_value": "transaction value",
    "log_inputs": "number of inputs",
    "log_outputs": "number of outputs",
    "log_fee_rate": "fee relative to value",
    "output_ratio": "small-to-large output ratio",
    "equal_out_frac": "share of equal-valued outputs",
    "log_respend": "time since the funding transaction",
    "log_next_spend": "time until the outputs were re-spent",
    "log_in_degree": "number of funding transactions",
    "log_out_degree": "number of spending transactions",
}
# The evidence signals with their wordings, present and absent.
EVIDENCE = {
    "gnn_prob": ("Graph neural network: laundering-topology probability", None),
    "anomaly": ("Isolation Forest: statistical outlier score", None),
    "origin_tor": ("First-seen origin is a Tor exit relay", "Origin is not a Tor exit relay"),
    "origin_vpn": ("First-seen origin is a commercial VPN range", "Origin is not a commercial VPN range"),
    "origin_hosting": ("First-seen origin is a datacentre / hosting range", "Origin is not a datacentre / hosting range"),
    "origin_exchange": ("First-seen origin is known exchange infrastructure", "Origin is not known exchange infrastructure"),
    "peel_chain": ("Member of a multi-hop peeling chain", "Not part of a multi-hop peeling chain"),
    "coinjoin": ("Equal-output mixing (CoinJoin) structure", "No equal-output mixing structure"),
    "velocity": ("Funds re-spent within minutes", None),
    "origin_burst": ("Burst of transactions from the same origin IP", None),
}


def tx_features(tx: DataFrame, degrees: DataFrame, delays: DataFrame) -> DataFrame:
    """(txid, the ten features): structure of the transaction, its fee rate, its place in the flow graph."""
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    joined = tx.join(degrees, "txid", "left").join(delays, "txid", "left").fillna(0, ["in_degree", "out_degree"]).fillna(NEVER_S, ["since", "until"])
    value = F.when(total("input_amounts") != 0, total("input_amounts")).otherwise(total("output_amounts"))
    n_out, top = F.size("output_amounts"), F.array_max("output_amounts")
    positive = (n_out > 1) & (top > 0)
    return joined.withColumn("value", value).select(
        "txid",
        F.log1p("value").alias("log_value"),
        F.log1p(F.size("input_addresses")).alias("log_inputs"),
        F.log1p(n_out).alias("log_outputs"),
        F.when(F.col("value") > 0, F.log10(F.coalesce("fee", F.lit(0.0)) / F.when(F.col("value") > 0, F.col("value")) + 1e-8)).otherwise(-8.0).alias("log_fee_rate"),
        F.when(positive, F.array_min("output_amounts") / F.when(top > 0, top)).otherwise(1.0).alias("output_ratio"),
        F.when(n_out <= 1, 0.0).when(top > 0, same_amounts(F.col("output_amounts")) / F.greatest(n_out, F.lit(1))).otherwise(1.0).alias("equal_out_frac"),
        F.log1p(F.greatest("since", F.lit(0.0))).alias("log_respend"),
        F.log1p(F.greatest("until", F.lit(0.0))).alias("log_next_spend"),
        F.log1p("in_degree").alias("log_in_degree"),
        F.log1p("out_degree").alias("log_out_degree"),
    )


def evidence(rows: DataFrame) -> DataFrame:
    """rows with the ten signals, from gnn_prob, anomaly, origin_category, peel_hops, coinjoin, since, until and burst."""
    flag = lambda c: F.coalesce((F.col("origin_category") == c).cast("double"), F.lit(0.0))
    log4 = lambda x: F.least(F.lit(1.0), F.log2(1.0 + x) / 4)
    return rows.withColumns({
        "origin_tor": flag("tor_exit"), "origin_vpn": flag("vpn"), "origin_hosting": flag("hosting"), "origin_exchange": flag("exchange"),
        "peel_chain": log4(F.coalesce("peel_hops", F.lit(0))),
        "velocity": F.exp(-F.least("since", "until") / 300.0),
        "origin_burst": log4(F.greatest(F.coalesce("burst", F.lit(0)), F.lit(0))),
    })


def risk(weights: dict[str, float], bias: float) -> Column:
    """Risk from 0 to 100 of a logistic fusion of the signals."""
    z = F.lit(bias)
    for name, w in weights.items():
        z = z + F.col(name) * w
    return 100.0 * sigmoid(z)


def shap(weights: dict[str, float], means: dict[str, Column] | dict[str, float]) -> dict[str, Column]:
    """Each signal's exact contribution to the log-odds, against its mean."""
    return {f"shap_{n}": w * (F.col(n) - (means[n] if isinstance(means[n], Column) else F.lit(means[n]))) for n, w in weights.items()}


def factors(names: list[str], top: int | None = None) -> Column:
    """Array of (key, label, value, shap, share_pct, impact) by decreasing size of contribution, from columns n and shap_n."""
    rising = F.lit(0.0)
    for n in names:
        rising = rising + F.greatest(F.col(f"shap_{n}"), F.lit(0.0))
    share = lambda n: F.round(100.0 * F.greatest(F.col(f"shap_{n}"), F.lit(0.0)) / F.when(rising == 0, 1.0).otherwise(rising), 1)

    def label(n: str) -> Column:
        there, absent = EVIDENCE.get(n, (n, None))
        return F.when(F.col(n) < 0.5, absent).otherwise(there) if absent else F.lit(there)

    items = F.array(*(F.struct(F.lit(n).alias("key"), label(n).alias("label"), F.round(F.col(n), 4).alias("value"), F.round(F.col(f"shap_{n}"), 4).alias("shap"), share(n).alias("share_pct"), F.format_string("%+.2f", F.col(f"shap_{n}")).alias("impact")) for n in names))
    order = lambda a, b: F.when(F.abs(a["shap"]) > F.abs(b["shap"]), -1).when(F.abs(a["shap"]) < F.abs(b["shap"]), 1).when(a["key"] < b["key"], -1).otherwise(1)
    out = F.array_sort(items, order)
    return F.slice(out, 1, top) if top else out


def what_if(weights: dict[str, float], bias: float, changed: dict[str, Column | float], least_hops: int | None = None) -> Column:
    """Risk with some signals replaced; with least_hops, shorter chains count as none."""
    z = F.lit(bias)
    for name, w in weights.items():
        x = changed.get(name, F.col(name))
        x = F.lit(x) if not isinstance(x, Column) else x
        if name == "peel_chain" and least_hops is not None:
            x = F.when(F.col("peel_hops") >= least_hops, x).otherwise(0.0)
        z = z + x * w
    return 100.0 * sigmoid(z)
