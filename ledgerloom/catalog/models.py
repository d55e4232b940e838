"""Walks, embeddings and models.

Trained results have no SQL; where a property of the result can be stated in
SQL, a query returns that property.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.catalog.products import _REGIONS, _given_embeddings
from ledgerloom.catalog.registry import query, table
from ledgerloom.catalog.standins import (
    CHURN_SQL,
    COVIEW_SQL,
    PAYABLES_SQL,
    PRODUCTS_SQL,
    RECEIVABLES_SQL,
    churn_customers,
    product_events,
    products,
    raw_payables,
    raw_receivables,
)
from ledgerloom.operators import embeddings as E, features as L, walks as W
from ledgerloom.plans import capital, churn, coview, recommend as R
from ledgerloom.session import materialize, scratch_path
from ledgerloom.sinks.writers import save_model
from ledgerloom.sources.readers import load_model

_made: dict[tuple, object] = {}


def _once(spark, d, name, make):
    """Fitted models and walks are shared by the queries of one session and folder."""
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _made:
        _made[key] = make()
    return _made[key]


def forget() -> None:
    """Fit again at the next use."""
    _made.clear()


def _edges(spark, d):
    return _once(spark, d, "edges", lambda: materialize(coview.coview_graph(product_events(spark, d)), "edges"))


def _walks(spark, d):
    return _once(spark, d, "walks", lambda: materialize(W.random_walks(_edges(spark, d)), "walks"))


def _embeddings(spark, d):
    return _once(
        spark, d, "embeddings", lambda: materialize(E.embed_walks(_walks(spark, d)), "vectors")
    )


def _churn(spark, d):
    return _once(spark, d, "churn", lambda: churn.fit_churn(churn_customers(spark, d)))


def _receivables(spark, d):
    return _once(
        spark, d, "ar", lambda: capital.fit_receivables(raw_receivables(spark, d), regions=_REGIONS)
    )


def _payables(spark, d):
    return _once(spark, d, "ap", lambda: capital.fit_payables(raw_payables(spark, d)))


@query()
def random_walks(spark, d):
    """Ten walks of fifty products from every product."""
    return _walks(spark, d)


@query(f"""
WITH {COVIEW_SQL}, n AS (SELECT pid_1 AS node FROM edges UNION SELECT pid_2 FROM edges)
SELECT node, 10 AS walks, 50 AS shortest, 50 AS longest, 490 AS steps_on_edges FROM n
""")
def walk_properties(spark, d):
    """Per start: number and length of walks, and how many of their steps follow an edge."""
    steps = F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda i: F.struct(
        F.greatest(F.get("path", i), F.get("path", i - 1)).alias("pid_1"),
        F.least(F.get("path", i), F.get("path", i - 1)).alias("pid_2"),
    ))
    walks = _walks(spark, d)
    shape = walks.groupBy(F.col("start").alias("node")).agg(
        F.count("*").alias("walks"), F.min(F.size("path")).alias("shortest"), F.max(F.size("path")).alias("longest")
    )
    taken = walks.select(F.col("start").alias("node"), F.inline(steps)).groupBy("node", "pid_1", "pid_2").count()
    on_edges = taken.join(_edges(spark, d), ["pid_1", "pid_2"], "left_semi").groupBy("node").agg(
        F.sum("count").alias("steps_on_edges")
    )
    return shape.join(on_edges, "node")


@query()
def item_embeddings(spark, d):
    return _embeddings(spark, d)


@query()
def item_embeddings_by_factors(spark, d):
    """The factorisation of the mutual information that skip-gram stands for."""
    return E.embed_walks(_walks(spark, d), method="factors")


@query(f"""
WITH {COVIEW_SQL}, n AS (SELECT pid_1 AS node FROM edges UNION SELECT pid_2 FROM edges)
SELECT count(*) AS items, 64 AS shortest, 64 AS longest FROM n
""")
def embedding_shape(spark, d):
    """Every product of the graph has one vector of 64 numbers."""
    size = F.size("embedding_vector")
    return _embeddings(spark, d).agg(
        F.countDistinct("pid").alias("items"), F.min(size).alias("shortest"), F.max(size).alias("longest")
    )


@query()
def recommend(spark, d):
    """Most similar product of every product, by the trained embeddings."""
    return R.recommend(_embeddings(spark, d), products(spark, d))


@query()
def embedding_map(spark, d):
    """Categorised products with plane coordinates."""
    return R.embedding_map(_embeddings(spark, d), products(spark, d))


@query()
def project_embeddings(spark, d):
    """Given vectors on their first three principal axes."""
    return E.project_embeddings(_given_embeddings(spark, d), 3).drop("embedding_vector")


@query()
def churn_scores(spark, d):
    """Every customer with the predicted flag."""
    return churn.score_churn(churn_customers(spark, d), _churn(spark, d).model)


@query(f"WITH {CHURN_SQL} SELECT count(*) AS customers, count(DISTINCT \"CustomerID\") AS flagged_once FROM churners")
def churn_score_shape(spark, d):
    """Scoring keeps every customer once and sets the flag on each."""
    scored = churn.score_churn(churn_customers(spark, d), _churn(spark, d).model)
    return scored.where(F.col("churn").isNotNull()).agg(
        F.count("*").alias("customers"), F.countDistinct("CustomerID").alias("flagged_once")
    )


@query()
def churn_accuracy(spark, d):
    """Accuracy on training and test rows, class counts before and after oversampling."""
    fit = _churn(spark, d)
    row = (fit.train_accuracy, fit.test_accuracy, *fit.before, *fit.after)
    names = "train_accuracy double, test_accuracy double, churn_before bigint, stay_before bigint, churn_after bigint, stay_after bigint"
    return spark.createDataFrame([row], names)


@query(f"WITH {CHURN_SQL} SELECT count(*) AS customers, 0 AS differing FROM churners")
def saved_model_scores(spark, d):
    """A saved and loaded pipeline predicts what the fitted one does."""
    model, path = _churn(spark, d).model, scratch_path(spark, "model")
    save_model(model, path)
    rows = churn_customers(spark, d)
    a = model.transform(rows).select("CustomerID", F.col("prediction").alias("a"))
    b = load_model(path).transform(rows).select("CustomerID", F.col("prediction").alias("b"))
    return a.join(b, "CustomerID").agg(
        F.count("*").alias("customers"), F.count_if(F.col("a") != F.col("b")).cast("int").alias("differing")
    )


@query(f"""
WITH {CHURN_SQL}, c AS (SELECT "Churn" AS label, count(*) AS n FROM churners GROUP BY 1)
SELECT label, (SELECT max(n) FROM c) AS rows FROM c
""")
def smote_balance(spark, d):
    """Both classes have the same number of rows after oversampling."""
    rows = churn_customers(spark, d).na.fill(0).select(
        F.array("CashbackAmount", "OrderCount", "Balance").alias("x"), F.col("Churn").alias("label")
    )
    rows = materialize(rows, "smote")
    return rows.unionByName(L.smote(rows, "x", "label")).groupBy("label").agg(F.count("*").alias("rows"))


@query("SELECT count(*) AS rows, 0 AS in_both, TRUE AS about_share FROM orders")
def hash_split(spark, d):
    """The two parts hold every row once; the first has its share within five standard deviations."""
    orders = table(spark, d, "orders")
    a, b = L.hash_split(orders, "o_orderkey", 0.7)
    parts = a.select("o_orderkey", F.lit(1).alias("a")).unionByName(b.select("o_orderkey", F.lit(0).alias("a")))
    per_key = parts.groupBy("o_orderkey").agg(F.sum("a").alias("a"), F.count("*").alias("n"))
    return per_key.agg(
        F.sum("n").alias("rows"),
        F.count_if((F.col("a") > 0) & (F.col("a") < F.col("n"))).cast("int").alias("in_both"),
        (F.abs(F.sum("a") / F.sum("n") - 0.7) < 5 * F.sqrt(0.7 * 0.3 / F.sum("n"))).alias("about_share"),
    )


@query()
def delay_models(spark, d):
    """R2 and squared error of both delay models on training and test rows."""
    rows = [(side, *fit.scores.values()) for side, fit in
            (("receivables", _receivables(spark, d)), ("payables", _payables(spark, d)))]
    names = [k + " double" for k in _receivables(spark, d).scores]
    return spark.createDataFrame(rows, "side string, " + ", ".join(names))


@query()
def delay_importances(spark, d):
    """Feature importances of both delay models."""
    rows = [
        (side, f, i)
        for side, fit in (("receivables", _receivables(spark, d)), ("payables", _payables(spark, d)))
        for f, i in zip(fit.features, fit.importances)
    ]
    return spark.createDataFrame(rows, "side string, feature string, importance double")


@query()
def working_capital_forecast(spark, d):
    """Net amount by predicted week of payment."""
    return capital.working_capital(
        raw_receivables(spark, d), raw_payables(spark, d),
        _receivables(spark, d).model, _payables(spark, d).model, regions=_REGIONS,
    )


def _totals(spark, d, settled):
    """Total receivable and payable amount over all predicted weeks, one-sided weeks included."""
    net = capital.working_capital(
        raw_receivables(spark, d), raw_payables(spark, d), _receivables(spark, d).model, _payables(spark, d).model,
        how="full", with_year=True, regions=_REGIONS, settled=settled,
    )
    return net.agg(*[F.round(F.sum(c), 1).alias(c) for c in ("amount_ar", "amount_ap", "working_capital")])


_TOTALS = f"""
WITH {RECEIVABLES_SQL}, {PAYABLES_SQL},
     a AS (SELECT sum(amount) AS amount_ar FROM ar WHERE is_open = {{0}}),
     b AS (SELECT sum(amount) AS amount_ap FROM ap WHERE status = '{{1}}')
SELECT round(amount_ar, 1) AS amount_ar, round(amount_ap, 1) AS amount_ap, round(amount_ar - amount_ap, 1) AS working_capital FROM a, b
"""


@query(_TOTALS.format(1, "Unpaid"))
def forecast_totals(spark, d):
    """The forecast spreads all open and unpaid amounts over its weeks and loses none."""
    return _totals(spark, d, False)


@query(_TOTALS.format(0, "Paid"))
def settled_totals(spark, d):
    """The weekly table of closed and paid invoices spreads all of their amounts."""
    return _totals(spark, d, True)


@query("SELECT TRUE AS beats_majority")
def churn_beats_majority(spark, d):
    """On the balanced training rows the forest is right more often than a fixed answer."""
    fit = _churn(spark, d)
    return spark.createDataFrame([(fit.train_accuracy > max(fit.after) / sum(fit.after),)], "beats_majority boolean")


@query("SELECT unnest(['payables', 'receivables']) AS side, TRUE AS beats_mean")
def delay_beats_mean(spark, d):
    """On the training rows both models err less than the mean delay does."""
    fits = {"receivables": _receivables(spark, d), "payables": _payables(spark, d)}
    return spark.createDataFrame([(s, f.scores["train_r2"] > 0) for s, f in fits.items()], "side string, beats_mean boolean")


@query("SELECT * FROM (VALUES ('payables', FALSE), ('receivables', TRUE)) t(side, tells), (SELECT TRUE AS no_worse_than_mean)")
def delay_holds_out(spark, d):
    """On test rows: the receivables model tells delays apart, and payables, whose delays are noise, stay at their mean."""
    fits = {"receivables": _receivables(spark, d), "payables": _payables(spark, d)}
    rows = [(s, f.scores["test_r2"] > 0.2, f.scores["test_r2"] > -0.05) for s, f in fits.items()]
    return spark.createDataFrame(rows, "side string, tells boolean, no_worse_than_mean boolean")


@query(f"WITH {CHURN_SQL} SELECT count(*) AS customers, 0 AS differing FROM churners")
def churn_flags(spark, d):
    """A customer is flagged exactly when the model predicts it to churn."""
    rows, model = churn_customers(spark, d), _churn(spark, d).model
    flagged = churn.score_churn(rows, model).select("CustomerID", "churn")
    found = model.transform(rows).groupBy("CustomerID").agg(F.max(F.col("prediction") == 1).alias("told"))
    return flagged.join(found, "CustomerID").agg(
        F.count("*").alias("customers"), F.count_if(F.col("churn") != F.col("told")).cast("int").alias("differing")
    )


@query("SELECT unnest(['payables', 'receivables']) AS side, TRUE AS shares")
def importances_are_shares(spark, d):
    """Importances are not negative and sum to one."""
    fits = {"receivables": _receivables(spark, d), "payables": _payables(spark, d)}
    rows = [(s, min(f.importances) >= 0 and abs(sum(f.importances) - 1) < 1e-9) for s, f in fits.items()]
    return spark.createDataFrame(rows, "side string, shares boolean")


def _mean_cosine(pairs, vectors):
    """Mean cosine over pairs (a, b) of items."""
    unit = vectors.select("pid", F.col("embedding_vector").cast("array<double>").alias("v"))
    a, b = unit.select(F.col("pid").alias("a"), F.col("v").alias("va")), unit.select(F.col("pid").alias("b"), F.col("v").alias("vb"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, z: s + z)
    cosine = dot("va", "vb") / F.sqrt(dot("va", "va") * dot("vb", "vb"))
    return pairs.join(a, "a").join(b, "b").agg(F.avg(cosine)).first()[0]


@query("SELECT unnest(['factors', 'skipgram']) AS method, TRUE AS walked_are_closer")
def embeddings_follow_walks(spark, d):
    """Items that often lie within the window of one another are closer than items that seldom do."""
    often = E.cooccurrences(_walks(spark, d)).where("a < b")
    bounds = often.selectExpr("percentile_approx(n, array(0.1, 0.9), 10000)").first()[0]
    rows = []
    for method in ("factors", "skipgram"):
        vectors = materialize(E.embed_walks(_walks(spark, d), method=method), "vectors")
        near, far = (_mean_cosine(often.where(c), vectors) for c in (f"n >= {bounds[1]}", f"n <= {bounds[0]}"))
        rows.append((method, near > far))
    return spark.createDataFrame(rows, "method string, walked_are_closer boolean")


@query(f"""
WITH {COVIEW_SQL}, n AS (SELECT pid_1 AS node FROM edges UNION SELECT pid_2 FROM edges)
SELECT node AS product_id, 1 AS answers, FALSE AS itself FROM n
""")
def recommend_answers(spark, d):
    """Every product of the graph has one recommendation, and it is another product."""
    found = R.recommend(_embeddings(spark, d), products(spark, d))
    return found.groupBy("product_id").agg(
        F.count("*").cast("int").alias("answers"), F.max(F.col("prod_id") == F.col("product_id").cast("string")).alias("itself")
    )


@query("SELECT count(*) AS placed, TRUE AS falling, TRUE AS uncorrelated FROM embeddings")
def projection_axes(spark, d):
    """Axes of the projection have falling variance and no correlation."""
    p = E.project_embeddings(_given_embeddings(spark, d), 3)
    v = [F.var_pop(f"x{i}") for i in range(3)]
    apart = [F.abs(F.corr(f"x{i}", f"x{j}")) < 1e-6 for i, j in ((0, 1), (0, 2), (1, 2))]
    return p.agg(
        F.count("*").alias("placed"), ((v[0] >= v[1]) & (v[1] >= v[2])).alias("falling"), (apart[0] & apart[1] & apart[2]).alias("uncorrelated")
    )


@query(f"""
WITH {COVIEW_SQL}, {PRODUCTS_SQL}, n AS (SELECT pid_1 AS node FROM edges UNION SELECT pid_2 FROM edges)
SELECT node AS pid, split_part(category_code, '.', 1) AS "L1", TRUE AS placed FROM n JOIN prod ON node = product_id
""")
def map_places(spark, d):
    """Every categorised product of the graph has a place in the plane and in space."""
    placed = R.embedding_maps(_embeddings(spark, d), products(spark, d))
    return placed.select("pid", "L1", (F.col("x0").isNotNull() & F.col("x1").isNotNull() & F.col("x2").isNotNull()).alias("placed"))


@query(f"""
WITH {COVIEW_SQL.replace("ts AS event_time", "strftime(ts, '%Y-%m-%d %H:%M:%S.%f') || ' UTC' AS event_text, ts AS event_time")}
SELECT pid_1, pid_2, occurrence_ct FROM edges
""")
def coview_graph_of_text_times(spark, d):
    """The graph from events whose time is text with a zone suffix."""
    events = product_events(spark, d)
    text = F.concat(F.date_format("event_time", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit(" UTC"))
    return coview.coview_graph(events.withColumn("event_time", text))
