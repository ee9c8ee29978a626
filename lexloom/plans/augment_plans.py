"""Queries of augmentation (k), with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexloom.operators import augment as A
from lexloom.plans.sampling_plans import _u
from lexloom.plans.text_plans import SPACE, _docs, _samples, q


def _rule(name: str):
    return lambda s, d: _docs(s, d).where("text is not null").select("doc_id", A.RULES[name](F.col("text"), 42, F.col("doc_id").cast("string")).alias("t"))


SQUEEZED = f"string_split(trim(regexp_replace(text, '{SPACE}', ' ', 'g')), ' ')"
FROM = "from documents where text is not null"


def _para() -> str:
    out = "text"
    for i, (p, to) in enumerate(A.REWRITES):
        for k in (1, 2, 3, 4, 5):
            to = to.replace(f"{{{k}}}", f"\\{k}")
        out = f"case when {_u(f'paraphrase{i}', 'doc_id')} < 0.2 then regexp_replace({out}, '(?i){q(p)}', '{q(to)}', 'g') else {out} end"
    return out


def _punct() -> str:
    sql = "d0 as (select doc_id, text t from documents where text is not null)"
    for n, (mark, to) in enumerate(A.PUNCTUATION.items()):
        new = f"[{', '.join(repr(x) for x in to)}][(floor({_u(f'mark{mark}', 'doc_id')} * {len(to)}) + 1)::BIGINT]"
        sql += f", d{n + 1} as (select doc_id, case when instr(t, '{mark}') > 0 and {_u(f'punctuation{mark}', 'doc_id')} < 0.3 then left(t, instr(t, '{mark}') - 1) || {new} || substr(t, instr(t, '{mark}') + 1) else t end t from d{n})"
    return f"with {sql} select doc_id, t from d{len(A.PUNCTUATION)}"


def _contract() -> str:
    wide = tight = "text"
    for a, b in A.CONTRACTIONS:
        wide = f"replace({wide}, '{q(a)}', '{q(b)}')"
    sql = "d0 as (select doc_id, text, text t from documents where text is not null)"
    for n, (a, b) in enumerate(A.CONTRACTIONS):
        u = _u(q(f"contract {a}"), "doc_id")
        sql += f", d{n + 1} as (select doc_id, text, case when {u} < 0.3 then replace(t, '{q(b)}', '{q(a)}') else t end t from d{n})"
    return f"with {sql} select doc_id, case when {_u('contraction', 'doc_id')} < 0.5 then {wide} else t end t from d{len(A.CONTRACTIONS)}"


_keys, _vals = "[" + ", ".join(f"'{k}'" for k in A.SYNONYMS) + "]", "[" + ", ".join(f"'{v}'" for v in A.SYNONYMS.values()) + "]"
_ins, _adv = "[" + ", ".join(f"'{w}'" for w in A.INSERT) + "]", "[" + ", ".join(f"'{w}'" for w in A.ADVERBS) + "]"

PLANS: dict[str, tuple] = {
    "k00_augment": (lambda s, d: A.augment(_samples(s, d).select("sample_id", "text", "label", "source", "confidence"), "sample_id").select("sample_id", "variant", "text", "original_text", "source", "confidence", F.array_join("augmentation_strategies", ",").alias("strategies")), None),
    "k01_synonym": (_rule("synonym"), f"select doc_id, array_to_string(list_transform(w, lambda x, i: case when ('0x' || substr(md5('42:' || doc_id || '/' || (i - 1) || ':synonym'), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.3 and list_contains({_keys}, lower(x)) then {_vals}[list_position({_keys}, lower(x))] else x end), ' ') t from (select doc_id, {SQUEEZED} w {FROM})"),
    "k02_paraphrase": (_rule("paraphrase"), f"select doc_id, case when len(list_filter(list_transform(regexp_split_to_array(text, '[.!?]+\\s+|[\\r\\n]+'), lambda x: trim(x)), lambda x: regexp_matches(x, '[^\\s\\p{{Z}}]'))) >= 2 then {_para()} else text end t {FROM}"),
    "k03_reorder": (_rule("reorder"), f"with a as (select doc_id, text, list_filter(list_transform(regexp_extract_all(text, '[^.!?\\r\\n]+[.!?]*'), lambda x: regexp_replace(x, '{A.EDGES}', '', 'g')), lambda x: x <> '') s {FROM}), b as (select doc_id, unnest(s) x, generate_subscripts(s, 1) - 1 i from a where len(s) between 2 and 4), m as (select doc_id, string_agg(x, ' ' order by ('0x' || substr(md5('42:' || doc_id || '/' || i || ':reorder'), 1, 8))::BIGINT, i) t from b group by 1) select doc_id, coalesce(t, text) t from a left join m using (doc_id)"),
    "k04_insert": (_rule("insert"), f"select doc_id, case when len(w) >= 5 then array_to_string(w[1:pos] || [list_extract({_ins}, (floor({_u('insert_word', 'doc_id')} * {len(A.INSERT)}) + 1)::BIGINT)] || w[pos + 1:], ' ') else text end t from (select *, (floor({_u('insert_at', 'doc_id')} * (len(w) - 1)) + 1)::BIGINT pos from (select doc_id, text, {SQUEEZED} w {FROM}))"),
    "k05_delete": (_rule("delete"), f"select doc_id, case when len(w) >= 8 and len(p) > 0 then array_to_string(list_filter(w, lambda x, i: i <> p[(floor({_u('delete', 'doc_id')} * len(p)) + 1)::BIGINT]), ' ') else text end t from (select *, list_filter(range(1, len(w) + 1), lambda i: list_contains({_adv}, lower(w[i]))) p from (select doc_id, text, {SQUEEZED} w {FROM}))"),
    "k06_punctuation": (_rule("punctuation"), _punct()),
    "k07_case": (_rule("case"), f"select doc_id, case when regexp_matches(left(text, 1), '^\\p{{Lu}}') and {_u('case', 'doc_id')} < 0.2 then lower(left(s, 1)) || substr(s, 2) else text end t from (select doc_id, text, trim(regexp_replace(text, '{SPACE}', ' ', 'g')) s {FROM})"),
    "k08_contraction": (_rule("contraction"), _contract()),
}
