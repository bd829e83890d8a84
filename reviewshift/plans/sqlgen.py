"""DuckDB SQL text for the oracle side of every registered query.

The oracle is an independent formulation in plain SQL (windows with
``row_number``, joins, CASE) of the same semantics; it is generated from
the same parameters (word lists, thresholds) as the Spark side.
DuckDB has no regex backreferences, so character runs are collapsed with
a per-character list filter.
"""

from __future__ import annotations

from ..functions import lexicon as lx
from ..functions import text as tx
from ..sources import fixtures as fx


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def in_list(xs) -> str:
    return "(" + ", ".join(q(x) for x in xs) + ")"


def with_(ctes: list[tuple[str, str]], final: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(f"{n} AS (\n{body}\n)" for n, body in ctes) + "\n" + final


# --- scalar fragments ---------------------------------------------------------

def strip(x: str) -> str:
    return f"trim({x}, {q(tx.WS_CHARS)})"


def emoji_out(x: str, repl: str = " ") -> str:
    return f"regexp_replace({x}, {q(tx.EMOJI_RE)}, {q(repl)}, 'g')"


def tokens(x: str) -> str:
    return f"list_filter(string_split_regex({x}, {q(tx.SPACE_RE)}), lambda k: k <> '')"


def token_count(x: str) -> str:
    return f"len({tokens(x)})"


def is_meaningful(x: str, n: int = lx.MIN_TEXT_LENGTH) -> str:
    s = strip(x)
    return (f"({x} IS NOT NULL AND length({s}) >= {n} "
            f"AND NOT regexp_full_match({s}, '\\p{{Nd}}+') "
            f"AND length({strip(emoji_out(s, ''))}) >= {n})")


def is_valid_review(x: str, n: int = lx.MIN_TEXT_LENGTH) -> str:
    s = strip(x)
    return (f"coalesce({x} IS NOT NULL AND length({s}) >= {n} "
            f"AND NOT regexp_full_match({s}, '\\p{{Nd}}+'), false)")


def prefix_head(x: str) -> str:
    """lower -> URL -> mention -> hashtag -> emoji."""
    e = f"lower({x})"
    for pat in (tx.URL_RE, tx.MENTION_RE, tx.HASHTAG_RE, tx.EMOJI_RE):
        e = f"regexp_replace({e}, {q(pat)}, ' ', 'g')"
    return e


def collapse_runs_from_chars(ch: str) -> str:
    """Keep a character unless it is a 2nd+ member of a run of >= 3 equal
    non-newline characters (same as ([^\\n])\\1{2,} -> $1)."""
    return (f"array_to_string(list_filter({ch}, lambda c, i: NOT coalesce(c <> chr(10) AND i > 1 "
            f"AND {ch}[i-1] = c AND ((i > 2 AND {ch}[i-2] = c) OR coalesce({ch}[i+1] = c, false)), "
            f"false)), '')")


def squeeze_punct(x: str) -> str:
    e = x
    for pat, rep in tx.PUNCT_RUNS:
        e = f"regexp_replace({e}, {q(pat)}, {q(rep)}, 'g')"
    return e


def slang(x: str, lexicon=None, whitelist=None) -> str:
    lexicon = lx.SLANG_DICT if lexicon is None else lexicon
    whitelist = lx.DOMAIN_WHITELIST if whitelist is None else whitelist
    wl = sorted({w.lower() for w in whitelist})
    lex = {k.lower(): v for k, v in lexicon.items() if k.lower() not in set(wl)}
    mp = "MAP {" + ", ".join(f"{q(k)}: {q(v)}" for k, v in sorted(lex.items())) + "}"
    body = (f"CASE WHEN lower(k) IN {in_list(wl)} THEN k "
            f"ELSE coalesce({mp}[lower(k)], k) END")
    return (f"coalesce(array_to_string(list_filter(list_transform(string_split_regex({x}, "
            f"{q(tx.SPACE_RE)}), lambda k: {body}), lambda k: k <> ''), ' '), '')")


def suffix(x: str) -> str:
    return (f"trim(regexp_replace(regexp_replace({x}, {q(tx.SYMBOL_RE)}, ' ', 'g'), "
            f"{q(tx.SPACE_RE)}, ' ', 'g'))")


def label_case(rating: str = "rating", text: str = "review_text",
               keywords=lx.NEGATIVE_KEYWORDS) -> str:
    low = f"lower(coalesce({text}, ''))"
    hit = " OR ".join(f"contains({low}, {q(k)})" for k in keywords)
    return (f"CASE WHEN {rating} IN (1, 2) THEN 'Negatif' WHEN ({hit}) THEN 'Negatif' "
            f"WHEN {rating} = 3 THEN 'Netral' ELSE 'Positif' END")


def md5_key(*cols: str, seed: int = lx.RANDOM_STATE) -> str:
    parts = ", ".join([q(str(seed))] + [f"CAST({c} AS VARCHAR)" for c in cols])
    return f"md5(concat_ws('|', {parts}))"


def initcap(x: str) -> str:
    """Title case of a one-word value (DuckDB has no initcap)."""
    return f"concat(upper(substr({x}, 1, 1)), lower(substr({x}, 2)))"


LABEL_ID = "CASE sentiment_label WHEN 'Negatif' THEN 0 WHEN 'Netral' THEN 1 WHEN 'Positif' THEN 2 END"


# --- CTE chains -----------------------------------------------------------------

def reviews_ctes() -> list[tuple[str, str]]:
    return [("reviews", fx.REVIEWS_SQL), ("raw", fx.RAW_SQL)]


def master_ctes(mode: str = "multi") -> list[tuple[str, str]]:
    """raw -> P4/P5 -> D1 -> M1 -> W2, ending in CTE ``master``."""
    s = strip("review_text")
    noise = (f"(rating = 3 AND (length({s}) < {lx.NEUTRAL_MIN_CHARS} "
             f"OR {strip('lower(review_text)')} IN {in_list(lx.NEUTRAL_FILLERS)}))")
    filt = f"length({s}) >= {lx.MIN_TEXT_LENGTH}" + (f" AND NOT {noise}" if mode == "multi" else "")
    ctes = reviews_ctes() + [
        ("conformed", """
SELECT coalesce(review_text, '') AS review_text, rating,
       coalesce(product_name, 'unknown') AS product_name, coalesce(review_date, 'unknown') AS review_date,
       coalesce(reviewer_name, 'anonymous') AS reviewer_name, source_platform, source_seq, row_seq
FROM raw WHERE """ + strip("review_text") + " <> ''"),
        ("filtered", f"SELECT * FROM conformed WHERE {filt}"),
        ("deduped", """
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY review_text ORDER BY source_seq, row_seq) AS rn
  FROM filtered) WHERE rn = 1"""),
        ("labelled", f"SELECT *, {label_case()} AS label FROM deduped"),
    ]
    if mode == "multi":
        ctes += [
            ("class_n", "SELECT label, count(*) AS n FROM labelled GROUP BY label"),
            ("target", "SELECT CAST(floor(quantile_cont(n, 0.5)) AS BIGINT) AS target FROM class_n"),
            ("master", f"""
SELECT * EXCLUDE (rk, target) FROM (
  SELECT l.*, row_number() OVER (PARTITION BY label ORDER BY {md5_key('source_seq', 'row_seq')},
                                  source_seq, row_seq) AS rk
  FROM labelled l) r, target WHERE rk <= target"""),
        ]
    else:
        ctes += [("master", "SELECT * FROM labelled")]
    return ctes


def clean_ctes(src: str = "master", text: str = "review_text", out: str = "cleaned",
               lexicon=None, whitelist=None) -> list[tuple[str, str]]:
    """T15 over ``src`` -> CTE ``out`` with condition + review_text_clean."""
    return [
        (f"{out}_m", f"SELECT * FROM {src} WHERE {is_meaningful(text)}"),
        (f"{out}_h", f"SELECT *, string_split({prefix_head(text)}, '') AS _ch FROM {out}_m"),
        (f"{out}_p", f"SELECT * EXCLUDE (_ch), {squeeze_punct(collapse_runs_from_chars('_ch'))} AS _pre "
                     f"FROM {out}_h"),
        (f"{out}_b", f"""
SELECT * EXCLUDE (_pre), 'baseline' AS condition, {suffix('_pre')} AS review_text_clean FROM {out}_p
UNION ALL
SELECT * EXCLUDE (_pre), 'proposed' AS condition, {suffix(slang('_pre', lexicon, whitelist))}
       AS review_text_clean FROM {out}_p"""),
        (out, f"SELECT * FROM {out}_b WHERE {token_count('review_text_clean')} >= {lx.MIN_TOKEN_COUNT}"),
    ]


def prefix_ctes(src: str, text: str, out: str) -> list[tuple[str, str]]:
    """CTEs ending in ``out`` = ``src`` plus ``_pre`` (T1..T7 of ``text``)."""
    return [
        (f"{out}_h", f"SELECT *, string_split({prefix_head(text)}, '') AS _ch FROM {src}"),
        (out, f"SELECT * EXCLUDE (_ch), {squeeze_punct(collapse_runs_from_chars('_ch'))} AS _pre "
              f"FROM {out}_h"),
    ]


def clean_text_expr(normalize: bool, pre: str = "_pre") -> str:
    """T12 from the shared prefix column."""
    return suffix(slang(pre)) if normalize else suffix(pre)


def pipeline_expr(raw: str, cleaned: str) -> str:
    """Null unless P2(raw) and >= MIN_TOKEN_COUNT tokens."""
    return (f"CASE WHEN {is_meaningful(raw)} AND {token_count(cleaned)} >= {lx.MIN_TOKEN_COUNT} "
            f"THEN {cleaned} END")


def approx_mode_sql(src: str, part: str, n_col: str, draws: str, out: str) -> str:
    return f"""
SELECT * EXCLUDE (_tot, _fl, _rem, _need, _rk), _fl + CASE WHEN _rk <= _need THEN 1 ELSE 0 END AS {out}
FROM (
  SELECT *, {draws} - sum(_fl) OVER (PARTITION BY {part}) AS _need,
         row_number() OVER (PARTITION BY {part} ORDER BY _rem DESC, label_id) AS _rk
  FROM (
    SELECT *, CAST(({draws} * {n_col}) // _tot AS BIGINT) AS _fl, ({draws} * {n_col}) % _tot AS _rem
    FROM (SELECT *, sum({n_col}) OVER (PARTITION BY {part}) AS _tot FROM {src})))"""


def split_ctes(src: str = "cleaned", strata: str = "source_platform, condition",
               out: str = "splits") -> list[tuple[str, str]]:
    """W4 over ``src`` (needs sentiment_label) -> CTE ``out`` with ``split``."""
    return [
        (f"{out}_c", f"""
SELECT {strata}, sentiment_label, {LABEL_ID} AS label_id, count(*) AS n_c,
       sum(count(*)) OVER (PARTITION BY {strata}) AS _n
FROM {src} GROUP BY {strata}, sentiment_label"""),
        (f"{out}_c2", f"SELECT *, CAST(_n - (_n * 3 + 9) // 10 AS BIGINT) AS _n_train FROM {out}_c"),
        (f"{out}_a1", approx_mode_sql(f"{out}_c2", strata, "n_c", "_n_train", "n_train")),
        (f"{out}_a2", f"""
SELECT *, CAST(_n_temp - (_n_temp + 1) // 2 AS BIGINT) AS _n_val FROM (
  SELECT *, n_c - n_train AS _t, sum(n_c - n_train) OVER (PARTITION BY {strata}) AS _n_temp
  FROM {out}_a1)"""),
        (f"{out}_a", approx_mode_sql(f"{out}_a2", strata, "_t", "_n_val", "n_val")),
        (f"{out}_r", f"""
SELECT *, row_number() OVER (PARTITION BY {strata}, sentiment_label
                             ORDER BY {md5_key('source_seq', 'row_seq')}, source_seq, row_seq) AS _rk
FROM {src}"""),
        (out, f"""
SELECT r.* EXCLUDE (_rk),
       CASE WHEN _rk <= a.n_train THEN 'train' WHEN _rk <= a.n_train + a.n_val THEN 'val'
            ELSE 'test' END AS split
FROM {out}_r r JOIN {out}_a a USING ({strata}, sentiment_label)"""),
    ]


def experiment_ctes() -> list[tuple[str, str]]:
    """master -> cleaned -> projected splits (CTE ``splits``)."""
    return (master_ctes() + clean_ctes() +
            [("cleaned_proj", "SELECT review_text_clean, review_text, rating, label AS sentiment_label, "
                           "source_platform, condition, source_seq, row_seq FROM cleaned")] +
            split_ctes("cleaned_proj"))


def nb_ctes(splits: str = "splits", doc_keys: str = "source_seq, row_seq") -> list[tuple[str, str]]:
    """F4 + F7 over the LOSO grid -> CTE ``preds`` (train_src, test_src,
    condition, keys, label_id, pred)."""
    return [
        ("tr", f"SELECT *, {LABEL_ID} AS label_id FROM {splits} WHERE split = 'train'"),
        ("te", f"SELECT *, {LABEL_ID} AS label_id FROM {splits} WHERE split = 'test'"),
        ("tr_tok", f"SELECT source_platform, condition, label_id, unnest({tokens('review_text_clean')}) "
                   f"AS token FROM tr"),
        ("nct", "SELECT source_platform, condition, token, label_id, count(*) AS n_ct "
                "FROM tr_tok GROUP BY ALL"),
        ("tot", """
SELECT source_platform, condition,
       sum(CASE WHEN label_id = 0 THEN n_ct ELSE 0 END) AS t0,
       sum(CASE WHEN label_id = 1 THEN n_ct ELSE 0 END) AS t1,
       sum(CASE WHEN label_id = 2 THEN n_ct ELSE 0 END) AS t2,
       count(DISTINCT token) AS v
FROM nct GROUP BY ALL"""),
        ("mdl", """
SELECT p.source_platform AS train_src, p.condition, p.token,
       ln((p.n0 + 1.0) / (t.t0 + t.v)) AS ll0, ln((p.n1 + 1.0) / (t.t1 + t.v)) AS ll1,
       ln((p.n2 + 1.0) / (t.t2 + t.v)) AS ll2
FROM (SELECT source_platform, condition, token,
             sum(CASE WHEN label_id = 0 THEN n_ct ELSE 0 END) AS n0,
             sum(CASE WHEN label_id = 1 THEN n_ct ELSE 0 END) AS n1,
             sum(CASE WHEN label_id = 2 THEN n_ct ELSE 0 END) AS n2
      FROM nct GROUP BY ALL) p JOIN tot t USING (source_platform, condition)"""),
        ("pri", """
SELECT source_platform AS train_src, condition,
       max(CASE WHEN label_id = 0 THEN pr END) AS p0, max(CASE WHEN label_id = 1 THEN pr END) AS p1,
       max(CASE WHEN label_id = 2 THEN pr END) AS p2
FROM (SELECT source_platform, condition, label_id,
             ln(count(*) / sum(count(*)) OVER (PARTITION BY source_platform, condition)) AS pr
      FROM tr GROUP BY source_platform, condition, label_id) GROUP BY train_src, condition"""),
        ("te_tok", f"""
SELECT {doc_keys}, condition, token, count(*) AS cnt FROM (
  SELECT {doc_keys}, condition, unnest({tokens('review_text_clean')}) AS token FROM te) GROUP BY ALL"""),
        ("sums", f"""
SELECT {doc_keys}, t.condition, m.train_src, sum(cnt * ll0) AS s0, sum(cnt * ll1) AS s1,
       sum(cnt * ll2) AS s2
FROM te_tok t JOIN mdl m ON t.condition = m.condition AND t.token = m.token GROUP BY ALL"""),
        ("scored", f"""
SELECT te.source_platform AS test_src, te.condition, p.train_src, te.label_id,
       round(p.p0 + coalesce(s.s0, 0), 6) AS sc0, round(p.p1 + coalesce(s.s1, 0), 6) AS sc1,
       round(p.p2 + coalesce(s.s2, 0), 6) AS sc2
FROM te JOIN pri p ON te.condition = p.condition
LEFT JOIN sums s ON s.source_seq = te.source_seq AND s.row_seq = te.row_seq
                 AND s.condition = te.condition AND s.train_src = p.train_src"""),
        ("preds", """
SELECT *, CASE WHEN sc0 >= sc1 AND sc0 >= sc2 THEN 0 WHEN sc1 >= sc2 THEN 1 ELSE 2 END AS pred
FROM scored"""),
    ]


def cells_cte(src: str = "preds", group: str = "train_src, test_src, condition") -> tuple[str, str]:
    cols = ", ".join(f"count_if(label_id = {i} AND pred = {j}) AS c{i}{j}"
                     for i in range(3) for j in range(3))
    return ("cells", f"SELECT {group}, {cols} FROM {src} GROUP BY {group}")


def scores_select(group: str, src: str = "cells") -> str:
    sup = [f"(c{i}0 + c{i}1 + c{i}2)" for i in range(3)]
    prd = [f"(c0{i} + c1{i} + c2{i})" for i in range(3)]
    f1 = [f"CASE WHEN {sup[i]} + {prd[i]} > 0 THEN 2.0 * c{i}{i} / ({sup[i]} + {prd[i]}) ELSE 0.0 END"
          for i in range(3)]
    pres = [f"CASE WHEN {sup[i]} + {prd[i]} > 0 THEN 1 ELSE 0 END" for i in range(3)]
    n = " + ".join(sup)
    macro = "(" + " + ".join(f"({f1[i]}) * {pres[i]}" for i in range(3)) + ") / (" + " + ".join(pres) + ")"
    return (f"SELECT {group}, CAST({n} AS BIGINT) AS n, round((c00 + c11 + c22) / ({n}), 6) AS accuracy, "
            f"round({macro}, 6) AS f1_macro, round({f1[0]}, 6) AS f1_negatif, "
            f"round({f1[1]}, 6) AS f1_netral, round({f1[2]}, 6) AS f1_positif FROM {src}")


def loso_ctes() -> list[tuple[str, str]]:
    """... -> CTE ``loso``: title-cased grid rows with n, accuracy, F1s, eval_type;
    ``cells`` keeps the lower-case confusion counts."""
    inner = scores_select("train_src, test_src, condition")
    return experiment_ctes() + nb_ctes() + [cells_cte(), ("loso", f"""
SELECT {initcap('train_src')} AS train_src, {initcap('test_src')} AS test_src,
       {initcap('condition')} AS condition, n, accuracy, f1_macro, f1_negatif, f1_netral, f1_positif,
       CASE WHEN train_src = test_src THEN 'In-Domain' ELSE 'Cross-Platform' END AS eval_type
FROM ({inner})""")]


def cells_long_select(src: str = "cells") -> str:
    """The 9 confusion cells as rows (title-cased grid keys)."""
    parts = [f"SELECT {initcap('train_src')} AS train_src, {initcap('test_src')} AS test_src, "
             f"{initcap('condition')} AS condition, {i} AS label_id, {j} AS pred_id, c{i}{j} AS n FROM {src}"
             for i in range(3) for j in range(3)]
    return " UNION ALL ".join(parts)


def fallback_expr(raw: str, cleaned: str) -> str:
    """The pipeline result, or lower+strip of the raw text when rejected."""
    pipe = pipeline_expr(raw, cleaned)
    return f"CASE WHEN coalesce({pipe}, '') = '' THEN {strip(f'lower({raw})')} ELSE {pipe} END"


def score_ctes(src: str = "reviews", key: str = "review_id", text: str = "review_text") -> list[tuple[str, str]]:
    """F7 over ``src`` with the models of ``nb_ctes`` -> CTE ``rscore``
    (key, train_src, condition, sc0..sc2, pred, cleaned)."""
    return prefix_ctes(src, text, "rpre") + [
        ("rclean", f"""
SELECT {key}, 'baseline' AS condition, {fallback_expr(text, clean_text_expr(False))} AS cleaned FROM rpre
UNION ALL
SELECT {key}, 'proposed' AS condition, {fallback_expr(text, clean_text_expr(True))} AS cleaned FROM rpre"""),
        ("rtok", f"SELECT {key}, condition, unnest({tokens('cleaned')}) AS token FROM rclean"),
        ("rsums", f"""
SELECT {key}, t.condition, m.train_src, sum(ll0) AS s0, sum(ll1) AS s1, sum(ll2) AS s2
FROM rtok t JOIN mdl m ON t.condition = m.condition AND t.token = m.token GROUP BY ALL"""),
        ("rsc", f"""
SELECT c.{key}, c.condition, p.train_src, c.cleaned,
       round(p.p0 + coalesce(s.s0, 0), 6) AS sc0, round(p.p1 + coalesce(s.s1, 0), 6) AS sc1,
       round(p.p2 + coalesce(s.s2, 0), 6) AS sc2
FROM rclean c JOIN pri p ON c.condition = p.condition
LEFT JOIN rsums s ON s.{key} = c.{key} AND s.condition = c.condition AND s.train_src = p.train_src"""),
        ("rscore", """
SELECT *, CASE WHEN sc0 >= sc1 AND sc0 >= sc2 THEN 0 WHEN sc1 >= sc2 THEN 1 ELSE 2 END AS pred,
       greatest(sc0, sc1, sc2) AS _mx,
       exp(sc0 - greatest(sc0, sc1, sc2)) + exp(sc1 - greatest(sc0, sc1, sc2))
         + exp(sc2 - greatest(sc0, sc1, sc2)) AS _z
FROM rsc"""),
    ]
