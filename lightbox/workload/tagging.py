"""Classifier queries: scoring, bookkeeping, training sets, end-to-end runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from lightbox.functions import vectors as V
from lightbox.operators import tagging as J
from lightbox.session import durable
from lightbox.workload.registry import query
from lightbox.workload.similarity import VECTOR_VIEWS, rounded, vectors

SCORE_VIEWS = {
    **VECTOR_VIEWS,
    "model_vec": "select tag, cast(weights as double[]) as w, bias, platt_a, platt_b from models",
    "scored": """
select u.id as media_id, m.tag, list_inner_product(u.u, m.w) - m.bias as raw, m.platt_a, m.platt_b
from unit u, model_vec m""",
}


@query(
    "j4_predict_score",
    """select media_id, tag, round(raw, 6) as raw from scored join raw_vec v on v.id = media_id
    where tag = 'label_' || cast(v.label as varchar)""",
    SCORE_VIEWS,
)
def _(lib):
    own = lib.embeddings.select(
        F.col("vec_id").alias("media_id"), "embedding", F.concat(F.lit("label_"), "label").alias("tag")
    )
    raw = J.predict_score(F.col("embedding"), F.col("weights"), F.col("bias"))
    return own.join(lib.models, "tag").select("media_id", "tag", F.round(raw, 6).alias("raw"))


@query(
    "j5_platt_probability",
    """select event_id as id, round(1 / (1 + exp(-2.0 * (value - 10) + 0.1)), 6) as probability from events""",
)
def _(lib):
    p = J.platt_probability(F.col("value") - 10, F.lit(-2.0), F.lit(0.1))
    return lib.events.select(F.col("event_id").alias("id"), F.round(p, 6).alias("probability"))


@query(
    "j6_batch_predict",
    """select media_id, tag, round(raw, 6) as raw, round(1 / (1 + exp(platt_a * raw + platt_b)), 6) as confidence from scored""",
    SCORE_VIEWS,
)
def _(lib):
    return rounded(rounded(J.batch_predict(vectors(lib), lib.models), "raw"), "confidence")


@query(
    "j10_stale_models",
    """select c.tag, c.n, cast(coalesce(m.trained_at_count, 0) as bigint) as trained_at_count
    from (select tag, count(*) as n from media_tags where not is_auto group by tag) c
    left join models m on m.tag = c.tag where c.n <> coalesce(m.trained_at_count, 0)""",
)
def _(lib):
    return J.stale_models(lib.media_tags, lib.models)


TRAINING_VIEWS = {
    **VECTOR_VIEWS,
    "labelled": "select t.tag, u.id, u.u from media_tags t join unit u on u.id = t.media_id where not t.is_auto",
    "tag_mean": """
select tag, pos, avg(x) as m, count(*) as n from
(select tag, unnest(u) as x, generate_subscripts(u, 1) as pos from labelled) group by tag, pos having count(*) >= 3""",
    "tag_center": """
select tag, list(m / norm order by pos) as c from
(select tag, pos, m, sqrt(sum(m * m) over (partition by tag)) as norm from tag_mean) group by tag""",
    "tag_spread": """
select l.tag, l.id, greatest(1 - list_inner_product(l.u, c.c), 0.0) as distance from labelled l join tag_center c on c.tag = l.tag""",
    "tag_kept": """
select tag, id from tag_spread join (select tag, count(*) as n, avg(distance) as m from tag_spread group by tag) using (tag)
where not (n > 5 and distance > 3 * m)""",
    "tag_near": """
select tag, id, distance, row_number() over (partition by tag order by distance, id) as ord from (
  select c.tag, u.id, greatest(1 - list_inner_product(u.u, c.c), 0.0) as distance from tag_center c, unit u
  where not exists (select 1 from media_tags t where t.tag = c.tag and t.media_id = u.id))""",
    "drawn": "select id, row_number() over (order by md5('42:' || cast(id as varchar)), id) as ord from unit",
}


@query(
    "j1_training_set",
    """select tag, 'pos' as part, cast(0 as bigint) as ord, id from tag_kept
    union all select tag, 'hard', ord, id from tag_near where ord <= 20 and distance > 0.05
    union all select k.tag, 'rand', d.ord, d.id from (select tag, count(*) as n from tag_kept group by tag) k
      join drawn d on d.ord <= least(greatest(3 * k.n, 30), 100)
      where not exists (select 1 from media_tags t where t.tag = k.tag and t.media_id = d.id)""",
    TRAINING_VIEWS,
)
def _(lib):
    return J.training_set(lib.media_tags, vectors(lib)).select("tag", "part", "ord", "id")


@query("j2_train_svm")
def _(lib):
    models = J.train_models(J.training_set(lib.media_tags, vectors(lib)))
    return models.select(
        "tag", F.size("weights").alias("dim"), F.round("bias", 3).alias("bias"),
        F.round(F.sqrt(V.dot(F.col("weights"), F.col("weights"))), 3).alias("norm"),
    )


@query("j3_platt_fit")
def _(lib):
    models = J.train_models(J.training_set(lib.media_tags, vectors(lib)))
    return models.select(
        "tag", F.round("platt_a", 3).alias("platt_a"), F.round("platt_b", 3).alias("platt_b")
    )


# Tags that have rows of both kinds, with their numbers; the optimum itself is proved by its gap.
FITTED = """select tag, count(*) filter (where part = 'pos') as n_pos, count(*) filter (where part <> 'pos') as n_neg from (
      select tag, 'pos' as part, id from tag_kept
      union all select tag, 'hard', id from tag_near where ord <= 20 and distance > 0.05
      union all select k.tag, 'rand', d.id from (select tag, count(*) as n from tag_kept group by tag) k
        join drawn d on d.ord <= least(greatest(3 * k.n, 30), 100)
        where not exists (select 1 from media_tags t where t.tag = k.tag and t.media_id = d.id)) group by tag"""


@query(
    "j2_duality_gap",
    f"select tag, n_pos, n_neg, true as optimal from ({FITTED}) where n_pos > 0 and n_neg > 0",
    TRAINING_VIEWS,
)
def _(lib):
    training = durable(J.training_set(lib.media_tags, vectors(lib)))
    models = durable(J.train_models(training, with_dual=True))
    gap = F.col("gap").between(-1e-6, 0.02)
    return J.duality_gaps(models, training).select("tag", "n_pos", "n_neg", gap.alias("optimal"))


@query(
    "j3_platt_slopes",
    f"select tag, n_pos + least(n_pos, n_neg) as n_fit, true as stationary from ({FITTED}) where n_pos > 0 and n_neg > 0",
    TRAINING_VIEWS,
)
def _(lib):
    training = durable(J.training_set(lib.media_tags, vectors(lib)))
    models = durable(J.train_models(training))
    flat = F.greatest(F.abs("slope_a"), F.abs("slope_b")) < 1e-3
    return J.platt_slopes(models, training).select("tag", "n_fit", flat.alias("stationary"))


@query("j7_learn_tag")
def _(lib):
    _, _, found = J.learn_tag("label_1", lib.media_tags, lib.models, vectors(lib))
    return rounded(rounded(found, "raw"), "confidence")


@query("j8_apply_tag_model")
def _(lib):
    tagged, _, _ = J.apply_tag_model(
        "label_2", lib.media_tags, lib.models, vectors(lib), lib.folder_media, "src0"
    )
    return rounded(tagged.where("tag = 'label_2'"), "confidence")


@query("j9_run_auto_tagging")
def _(lib):
    run = J.run_auto_tagging(lib.media_tags, lib.models, vectors(lib))
    report = lib.spark.createDataFrame(
        [("before", run.before), ("after", run.after), ("models_processed", run.models_processed)],
        "tag string, n long",
    )
    per_tag = run.media_tags.where("is_auto").groupBy("tag").agg(F.count("*").alias("n"))
    return per_tag.unionByName(report)
