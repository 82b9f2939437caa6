"""Schemas, constants and column order shared by all modules."""

from pyspark.sql import types as T

# Defaults that results have to agree with.
EPS = 1e-9
LAMBDA = 0.94
HORIZON = 30
ALPHA = 2.0
GATE = 0.6731
SECOND_GATE = 0.5
LOOKBACK = 30
BASELINE_ROWS = 60
FLUSH_ROWS = 1000

#: The feature vector's order.
FEATURES = ["r_t", "sigma_hat", "OFI_t", "Imbalance_t", "VolSpike_t", "msg_count"]

TRADE = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("price", T.DoubleType()),
        T.StructField("qty", T.DoubleType()),
        T.StructField("is_buyer_maker", T.BooleanType()),
    ]
)
#: A live message: symbol, trade time in epoch milliseconds, price and quantity as strings, buyer-is-maker.
MESSAGE = T.StructType(
    [
        T.StructField("s", T.StringType()),
        T.StructField("T", T.LongType()),
        T.StructField("p", T.StringType()),
        T.StructField("q", T.StringType()),
        T.StructField("m", T.BooleanType()),
    ]
)
THRESHOLD = T.StructType(
    [T.StructField(n, T.DoubleType()) for n in ("thr", "precision", "recall", "f1", "fbeta", "ap")]
    + [T.StructField("policy", T.StringType())]
    + [T.StructField(n, T.DoubleType()) for n in ("beta", "min_precision", "min_recall")]
)
THRESHOLDS = T.StructType(
    [
        T.StructField("tag", T.StringType()),
        T.StructField("thr_policy", T.StringType()),
        T.StructField("beta", T.DoubleType()),
        T.StructField("min_precision", T.DoubleType()),
        T.StructField("min_recall", T.DoubleType()),
        T.StructField("use_logit_adjust", T.BooleanType()),
        T.StructField("la_tau", T.DoubleType()),
        T.StructField("models", T.MapType(T.StringType(), T.MapType(T.StringType(), THRESHOLD))),
    ]
)
