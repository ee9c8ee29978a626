"""The queries of the subpackage: name -> f(spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import p1_overlap, p2_near, p3_truncated, p4_canonical, p5_language, p6_personal, p7_tokens, p8_containers, p9_garbled
from .base import table


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": lambda s, d: p1_overlap.found(table(s, d, "samples")),
        "p1_report": lambda s, d: p1_overlap.report(table(s, d, "samples"), table(s, d, "dataset_splits")),
        "p2_found": lambda s, d: p2_near.found(table(s, d, "samples")),
        "p2_groups": lambda s, d: p2_near.groups(table(s, d, "samples")),
        "p3_found": lambda s, d: p3_truncated.found(table(s, d, "generation_results")),
        "p3_report": lambda s, d: p3_truncated.report(table(s, d, "generation_results")),
        "p4_found": lambda s, d: p4_canonical.found(table(s, d, "samples")),
        "p4_collapsed": lambda s, d: p4_canonical.collapsed(table(s, d, "samples")),
        "p4_report": lambda s, d: p4_canonical.report(table(s, d, "samples"), table(s, d, "quality_metrics")),
        "p5_found": lambda s, d: p5_language.found(table(s, d, "samples")),
        "p5_segments": lambda s, d: p5_language.labelled(table(s, d, "samples")),
        "p6_found": lambda s, d: p6_personal.found(table(s, d, "pii_results"), table(s, d, "name_lexicon")),
        "p6_cleaned": lambda s, d: p6_personal.scanned(table(s, d, "pii_results"), table(s, d, "name_lexicon")).selectExpr("result_id", "cleaned_text", "size(found) as n_values", "size(found) > 0 as has_pii"),
        "p7_ids": lambda s, d: p7_tokens.ids(table(s, d, "documents")),
        "p9_found": lambda s, d: p9_garbled.found(table(s, d, "documents")),
        "p9_restored": lambda s, d: p9_garbled.restored(table(s, d, "documents")),
        "p8_packed": lambda s, d: p8_containers.packed(p7_tokens.sizes(table(s, d, "documents"))),
        "p8_containers": lambda s, d: p8_containers.containers(p7_tokens.sizes(table(s, d, "documents"))),
    }


#: Distinct windows of the normal forms, and exact joins over them; the second one meets texts by the rarest windows that a partner must share.
_GRAMS = """n as (select sample_id, task_id, split, trim(regexp_replace(lower(text), '[^\\p{L}\\p{M}\\p{N}]+', ' ', 'g'), ' ') t from samples where text is not null), d as (select * from n where length(t) >= 20),
    u as (select t, min(sample_id) id from d group by 1), g as (select distinct id, unnest(list_transform(range(1, length(t) - 3), lambda i: substr(t, i, 5))) g from u), z as (select id, count(*) k from g group by 1)"""


_PLAIN = "regexp_replace(lower({x}), '[^\\p{{L}}\\p{{M}}\\p{{N}}]+', '', 'g')"
_NAME = "^[\\s\\p{{Z}}]*(\\p{{L}}[\\p{{L}}\\p{{M}}]*)[\\s\\p{{Z}}]*[:：]".replace("{{", "{").replace("}}", "}")
#: Canonical forms: the pairs of JSON objects and of `name: value` fields, or the letters, marks and numbers.
_FORMS = f"""t as (select sample_id, text, regexp_replace(text, '^[\\s\\p{{Z}}\\p{{Cf}}]+|[\\s\\p{{Z}}\\p{{Cf}}]+$', '', 'g') b, list_filter(regexp_split_to_array(text, '[|\\r\\n]+'), lambda x: regexp_matches(x, '[^\\s\\p{{Z}}]')) f from samples where text is not null),
    q as (select *, case when starts_with(b, '{{') and json_valid(b) then list_transform(json_keys(b), lambda k: {_PLAIN.format(x="k")} || '=' || {_PLAIN.format(x="json_extract_string(b, '$.' || k)")})
        when len(f) >= 2 and len(list_filter(f, lambda x: regexp_matches(x, '{_NAME}'))) = len(f) then list_transform(f, lambda x: {_PLAIN.format(x=f"regexp_extract(x, '{_NAME}', 1)")} || '=' || {_PLAIN.format(x=f"regexp_replace(x, '{_NAME}', '')")}) end pairs, {_PLAIN.format(x="text")} p from t),
    forms as (select sample_id, case when p = '' then null when pairs is not null then 'R' || array_to_string(list_sort(list_distinct(pairs)), '|') else 'T' || p end c from q)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"""with {_GRAMS}, m as (select sample_id, task_id, split, id from d join u using (t)), c as (select a.sample_id x, b.sample_id y, a.id i, b.id j from m a join m b on a.task_id = b.task_id and a.split = 'train' and b.split in ('val', 'validation', 'test')),
            p as (select distinct i, j from c where i <> j), s as (select i, j, count(*) common from p join g a on a.id = i join g b on b.id = j and b.g = a.g group by 1, 2), ok as (select i, j from s join z zi on zi.id = i join z zj on zj.id = j where common >= 0.7 * (zi.k + zj.k - common) - 1e-9)
            select distinct least(x, y) sample_id_a, greatest(x, y) sample_id_b from c where i = j or (i, j) in (select (i, j) from ok)""",
        "p2_found": f"""with {_GRAMS}, f as (select g, count(*) f from g group by 1), r as (select id, g, row_number() over (partition by id order by f, g) rk from g join f using (g)), pre as (select id, g from r join z using (id) where rk <= k - ceil(0.8 * k - 1e-9) + 1),
            p as (select distinct a.id i, b.id j from pre a join pre b on a.g = b.g and a.id < b.id), s as (select i, j, count(*) common from p join g a on a.id = i join g b on b.id = j and b.g = a.g group by 1, 2),
            ok as (select i, j from s join z zi on zi.id = i join z zj on zj.id = j where common >= 0.8 * (zi.k + zj.k - common) - 1e-9), m as (select sample_id, id from d join u using (t))
            select least(a.sample_id, b.sample_id) sample_id_a, greatest(a.sample_id, b.sample_id) sample_id_b from ok join m a on a.id = i join m b on b.id = j union all select a.sample_id, b.sample_id from m a join m b on a.id = b.id and a.sample_id < b.sample_id""",
        "p4_found": f"""with {_FORMS} select a sample_id_a, sample_id sample_id_b from (select sample_id, min(sample_id) over (partition by c) a from forms where c is not null) where sample_id <> a""",
        "p4_collapsed": f"""with {_FORMS} select min(sample_id) sample_id, count(*) copies from forms where c is not null group by c""",
    }
