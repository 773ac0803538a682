"""DuckDB SQL equal in meaning to each registered query (column names match).

Seeded orders use ``md5('<seed>:' || key)``; fractions are DOUBLE (never
DECIMAL) so split sizes match; floats are rounded to 6 digits.
"""

from __future__ import annotations

# Fixed values shared with the Spark side (see functions/text.py).
TOKEN_RE = r"[\p{L}\p{N}_]{2,}"
WS_RE = r"\s+"

SEED_KEY = "md5('42:' || CAST(doc_id AS VARCHAR))"

N_TEST = "ceil(CAST(0.3 AS DOUBLE) * n)"
N_VAL = "ceil((CAST(2 AS DOUBLE) / 7) * (n - " + N_TEST + "))"
SPLIT_CASE = ("CASE WHEN rk < " + N_TEST + " THEN 'test' WHEN rk < " + N_TEST + " + " + N_VAL
              + " THEN 'val' ELSE 'train' END")

SPLIT = (
    "split AS (SELECT doc_id, label, " + SPLIT_CASE + " AS split FROM ("
    " SELECT doc_id, lang AS label,"
    " row_number() OVER (PARTITION BY lang ORDER BY " + SEED_KEY + ", doc_id) - 1 AS rk,"
    " count(*) OVER (PARTITION BY lang) AS n FROM documents) s0)"
)

TOK = ("tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '" + TOKEN_RE + "')) AS token "
       "FROM documents), tc AS (SELECT doc_id, token, count(*) AS tf FROM tok GROUP BY doc_id, token)")

WORDS = "CAST(len(list_filter(regexp_split_to_array(text, '" + WS_RE + "'), lambda x: x <> '')) AS INTEGER)"

TRAIN_TC = "tr AS (SELECT * FROM tc WHERE doc_id IN (SELECT doc_id FROM split WHERE split = 'train'))"
TEST_TC = "te AS (SELECT * FROM tc WHERE doc_id IN (SELECT doc_id FROM split WHERE split = 'test'))"

IDF = ("idf AS (SELECT token, ln((1 + nd.n) / (1 + count(*))) + 1 AS idf FROM tr, "
       "(SELECT count(*) AS n FROM split WHERE split = 'train') nd GROUP BY token, nd.n)")


def _tfidf(src: str, name: str) -> str:
    return (name + " AS (SELECT doc_id, token, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM "
            "(SELECT " + src + ".doc_id, " + src + ".token, " + src + ".tf * idf.idf AS w FROM " + src
            + " JOIN idf USING (token)) x)")


QUOTES = ("q AS (SELECT conv_id, "
          + ", ".join(f"max(CASE WHEN turn = {i} THEN text END) AS quote_{i + 1}" for i in range(10))
          + " FROM conversations GROUP BY conv_id)")


def _nb(value: str, train_src: str, test_src: str) -> str:
    """CTEs ending in ``res(doc_id, label, prediction)``."""
    return (
        "trd AS (SELECT doc_id, label FROM split WHERE split = 'train'), "
        "ted AS (SELECT doc_id, label FROM split WHERE split = 'test'), "
        "trx AS (SELECT x.doc_id, x.token, x." + value + " AS v, d.label FROM " + train_src
        + " x JOIN trd d USING (doc_id)), "
        "terms AS (SELECT label, token, CAST(sum(v) AS DOUBLE) AS n_ct FROM trx GROUP BY label, token), "
        "vsize AS (SELECT count(DISTINCT token) AS v FROM trx), "
        "cls AS (SELECT label, count(*) AS n_docs FROM trd GROUP BY label), "
        "mass AS (SELECT label, sum(n_ct) AS n_c FROM terms GROUP BY label), "
        "classes AS (SELECT c.label, CAST(row_number() OVER (ORDER BY c.label) - 1 AS INTEGER) AS class_index, "
        "c.n_docs, ln(c.n_docs / (SELECT count(*) FROM trd)) AS log_prior, "
        "ln(1) - ln(coalesce(m.n_c, 0) + 1 * (SELECT v FROM vsize)) AS base_rate "
        "FROM cls c LEFT JOIN mass m USING (label)), "
        "known AS (SELECT x.doc_id, x.token, x." + value + " AS v FROM " + test_src + " x "
        "WHERE x.doc_id IN (SELECT doc_id FROM ted) AND x.token IN (SELECT token FROM terms)), "
        "dlen AS (SELECT doc_id, CAST(sum(v) AS DOUBLE) AS l FROM known GROUP BY doc_id), "
        "sp AS (SELECT k.doc_id, t.label, sum(k.v * (ln(t.n_ct + 1) - ln(1))) AS s "
        "FROM known k JOIN terms t USING (token) GROUP BY k.doc_id, t.label), "
        "scores AS (SELECT d.doc_id, c.label AS cls, c.class_index, "
        "c.log_prior + coalesce(dlen.l, 0) * c.base_rate + coalesce(sp.s, 0) AS score "
        "FROM ted d CROSS JOIN classes c LEFT JOIN dlen ON dlen.doc_id = d.doc_id "
        "LEFT JOIN sp ON sp.doc_id = d.doc_id AND sp.label = c.label), "
        "res AS (SELECT s.doc_id, d.label, s.cls AS prediction FROM (SELECT *, row_number() OVER "
        "(PARTITION BY doc_id ORDER BY score DESC, class_index) AS rn FROM scores) s "
        "JOIN ted d USING (doc_id) WHERE s.rn = 1)"
    )


NB_TF = "WITH " + SPLIT + ", " + TOK + ", " + _nb("tf", "tc", "tc")
NB_TFIDF = ("WITH " + SPLIT + ", " + TOK + ", " + TRAIN_TC + ", " + TEST_TC + ", " + IDF + ", "
            + _tfidf("tr", "trw") + ", " + _tfidf("te", "tew") + ", " + _nb("weight", "trw", "tew"))

PER_CLASS = (
    "t AS (SELECT label AS cls, count(*) AS n_true, sum(CASE WHEN label = prediction THEN 1 ELSE 0 END) AS tp "
    "FROM res GROUP BY label), p AS (SELECT prediction AS cls, count(*) AS n_pred FROM res GROUP BY prediction), "
    "f AS (SELECT coalesce(t.cls, p.cls) AS cls, coalesce(n_true, 0) AS n_true, coalesce(n_pred, 0) AS n_pred, "
    "coalesce(tp, 0) AS tp FROM t FULL OUTER JOIN p ON t.cls = p.cls)"
)

CONFUSION = (
    ", ax AS (SELECT DISTINCT c FROM (SELECT label AS c FROM res UNION ALL SELECT prediction FROM res) u), "
    "cnt AS (SELECT label, prediction, count(*) AS n FROM res GROUP BY label, prediction) "
    "SELECT a.c AS label, b.c AS prediction, coalesce(cnt.n, 0) AS n FROM ax a CROSS JOIN ax b "
    "LEFT JOIN cnt ON cnt.label = a.c AND cnt.prediction = b.c"
)

METRICS = (
    ", " + PER_CLASS + " SELECT round(sum(tp) / sum(n_true), 6) AS accuracy, "
    "round(avg(CASE WHEN n_true + n_pred > 0 THEN CAST(2 AS DOUBLE) * tp / (n_true + n_pred) ELSE 0 END), 6) "
    "AS macro_f1, CAST(sum(n_true) AS BIGINT) AS n, count(*) AS n_classes FROM f"
)

RANK_BY_LANG = ("SELECT doc_id, lang AS label, row_number() OVER (PARTITION BY lang ORDER BY " + SEED_KEY
                + ", doc_id) - 1 AS rk FROM documents")
MIN_CLASS = "m AS (SELECT min(n) AS m FROM (SELECT count(*) AS n FROM documents GROUP BY lang) c)"

def _feistel(round_: str, half: str) -> str:
    return f"CAST('0x' || substr(md5('42:' || epoch || ':{round_}:' || {half}), 1, 8) AS BIGINT)"


ORACLE = {
    "class_sizes": "SELECT lang, count(*) AS n FROM documents GROUP BY lang",
    "min_class_size": "SELECT min(n) AS min_class_size FROM (SELECT count(*) AS n FROM documents GROUP BY lang) c",
    "label_map_first_seen": (
        "SELECT lang AS label, CAST(row_number() OVER (ORDER BY min(doc_id), lang) - 1 AS INTEGER) AS label_id "
        "FROM documents GROUP BY lang"),
    "encode_decode": (
        "WITH " + SPLIT + ", lm AS (SELECT label, CAST(row_number() OVER (ORDER BY min(doc_id), label) - 1 "
        "AS INTEGER) AS label_id FROM split WHERE split = 'train' GROUP BY label) "
        "SELECT d.doc_id, d.lang, lm.label_id, lm2.label AS decoded FROM documents d "
        "LEFT JOIN lm ON d.lang = lm.label LEFT JOIN lm lm2 ON lm.label_id = lm2.label_id"),
    "filter_isin": "SELECT doc_id, lang, source FROM documents WHERE lang IN ('en', 'fr')",
    "dropna_project": (
        "WITH " + QUOTES + " SELECT conv_id, quote_1 AS text FROM q WHERE conv_id IS NOT NULL AND "
        + " AND ".join(f"quote_{i} IS NOT NULL" for i in range(1, 7))),
    "fillna_concat": (
        "WITH " + QUOTES + " SELECT conv_id, concat_ws(' ', "
        + ", ".join(f"coalesce(quote_{i}, '')" for i in range(1, 11)) + ") AS text FROM q"),
    "rename_drop": "SELECT n_nationkey AS id, n_name AS name FROM nation",
    "cast_concat_sep": (
        "SELECT d.doc_id, d.lang AS label, concat_ws(' [SEP] ', coalesce(d.text, 'nan'), coalesce(d.source, 'nan'), "
        "coalesce(c.role, 'nan'), coalesce(CAST(d.n_chars AS VARCHAR), 'nan')) AS text FROM documents d "
        "LEFT JOIN (SELECT conv_id, role FROM conversations WHERE turn = 0) c ON c.conv_id = d.doc_id"),
    "union_by_name": (
        "SELECT doc_id, text, lang FROM documents UNION ALL "
        "SELECT item_id AS doc_id, text, CAST(NULL AS VARCHAR) AS lang FROM benchmark"),
    "head_per_label": (
        "SELECT lang, doc_id, CAST(rn AS INTEGER) AS rank_in_label FROM (SELECT lang, doc_id, "
        "row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn FROM documents) x WHERE rn <= 20"),
    "epoch_orders": (
        "WITH RECURSIVE size AS (SELECT n, a, (n + a - 1) // a AS b FROM (SELECT n, CAST(floor(sqrt(n - 1)) AS BIGINT) + 1 AS a FROM "
        "(SELECT count(*) AS n FROM documents) c) s), "
        "p AS (SELECT row_number() OVER () - 1 AS pos, doc_id FROM documents), "
        "walk AS (SELECT epoch, doc_id, pos AS x, FALSE AS moved FROM p, (VALUES (0), (1)) e(epoch) UNION ALL "
        "SELECT epoch, doc_id, l3 * b + (r2 + " + _feistel("3", "l3") + ") % b AS x, TRUE AS moved FROM ("
        "SELECT *, (l1 + " + _feistel("2", "r2") + ") % a AS l3 FROM ("
        "SELECT *, (r0 + " + _feistel("1", "l1") + ") % b AS r2 FROM ("
        "SELECT *, (l0 + " + _feistel("0", "r0") + ") % a AS l1 FROM ("
        "SELECT *, x // b AS l0, x % b AS r0 FROM walk, size WHERE NOT moved OR x >= n) t0) t1) t2) t3) "
        "SELECT epoch, doc_id, x AS place, x // 8 AS batch_id FROM walk, size WHERE moved AND x < n"),
    "row_by_position": ("SELECT pos, doc_id, lang, text FROM (SELECT row_number() OVER () - 1 AS pos, doc_id, lang, text FROM documents) t "
                        "WHERE pos >= 100 AND pos < 132"),
    "row_at": "SELECT doc_id, lang, text FROM documents WHERE lang = 'fr' ORDER BY doc_id LIMIT 1 OFFSET 30",
    "first_n": "SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT 8",
    "shuffle": ("SELECT doc_id, row_number() OVER (ORDER BY " + SEED_KEY + ", doc_id) - 1 AS shuffle_rank "
                "FROM documents"),
    "split_two_way": (
        "SELECT doc_id, CASE WHEN rk < n - floor(CAST(0.7 AS DOUBLE) * n) THEN 'test' ELSE 'train' END AS split "
        "FROM (SELECT doc_id, row_number() OVER (ORDER BY " + SEED_KEY + ", doc_id) - 1 AS rk, "
        "count(*) OVER () AS n FROM documents) x"),
    "split_stratified": "WITH " + SPLIT + " SELECT doc_id, label, split FROM split",
    "downsample_balanced": (
        "WITH r AS (" + RANK_BY_LANG + "), " + MIN_CLASS + " SELECT doc_id, label FROM r, m WHERE r.rk < m.m"),
    "split_balanced": (
        "WITH r AS (" + RANK_BY_LANG + "), " + MIN_CLASS + ", kept AS (SELECT doc_id, label, rk, m.m AS n "
        "FROM r, m WHERE r.rk < m.m) SELECT doc_id, label, " + SPLIT_CASE + " AS split FROM kept"),
    "stage_rows": "WITH " + SPLIT + " SELECT doc_id, label, split FROM split WHERE split IN ('train', 'val')",
    "mean_word_count": "SELECT round(avg(" + WORDS + "), 6) AS mean_words, count(*) AS n_rows FROM documents",
    "word_tokens": (
        "SELECT doc_id, CAST(len(regexp_extract_all(lower(text), '" + TOKEN_RE + "')) AS INTEGER) AS n_tokens, "
        + WORDS + " AS n_words FROM documents"),
    "term_counts": "WITH " + TOK + " SELECT doc_id, token, tf FROM tc",
    "vocab": (
        "WITH " + SPLIT + ", " + TOK + ", " + TRAIN_TC + " SELECT token, count(DISTINCT doc_id) AS df, "
        "CAST(row_number() OVER (ORDER BY token) - 1 AS INTEGER) AS term_id FROM tr GROUP BY token"),
    "known_terms": (
        "WITH " + SPLIT + ", " + TOK + ", " + TRAIN_TC + ", " + TEST_TC
        + " SELECT doc_id, token, tf FROM te WHERE token IN (SELECT token FROM tr)"),
    "tfidf": (
        "WITH " + SPLIT + ", " + TOK + ", " + TRAIN_TC + ", " + TEST_TC + ", " + IDF + ", " + _tfidf("te", "tew")
        + " SELECT doc_id, token, round(weight, 6) AS weight FROM tew"),
    "nb_model": (
        NB_TF + " SELECT label, class_index, n_docs, round(log_prior, 6) AS log_prior, "
        "round(base_rate, 6) AS base_rate FROM classes"),
    "nb_predict": NB_TF + " SELECT doc_id, label, prediction FROM res",
    "nb_tfidf_predict": NB_TFIDF + " SELECT doc_id, label, prediction FROM res",
    "nb_confusion": NB_TF + CONFUSION,
    "nb_metrics": NB_TF + METRICS,
    "nb_metrics_observed": NB_TF + METRICS,
    "nb_saved": NB_TF + " SELECT doc_id, label, prediction FROM res",
}


# ---------------------------------------------------------------------------
# Second half: batches, vectors, augmentation, round trips, registry, scoring
# ---------------------------------------------------------------------------

E_D = "CAST(embedding AS DOUBLE[])"
NORM_E = ("list_transform(e, lambda x: x / greatest(sqrt(list_sum(list_transform(e, lambda y: y * y))), 1e-12))")
# dot products of the whole vector with each label's mean, in label order
MEANS = ("mv AS (SELECT label, list(a ORDER BY i) AS mean FROM (SELECT label, i, avg(CAST(v AS DOUBLE)) AS a FROM "
         "(SELECT label, unnest(embedding) AS v, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) u "
         "GROUP BY label, i) g GROUP BY label), mm AS (SELECT list(mean ORDER BY label) AS means FROM mv), "
         "lg AS (SELECT vec_id, label, list_transform(means, lambda q: list_dot_product(CAST(embedding AS DOUBLE[]), q)) AS l "
         "FROM embeddings, mm)")
ARGMAX_L = "list_position(l, list_max(l)) - 1"

VOCAB_IDS = ("v AS (SELECT token, CAST(row_number() OVER (ORDER BY token) - 1 AS INTEGER) AS term_id "
             "FROM (SELECT DISTINCT token FROM tr) x)")
IDS = (
    "pt AS (SELECT doc_id, unnest(t) AS token, unnest(range(len(t))) AS i FROM "
    "(SELECT doc_id, regexp_extract_all(lower(text), '" + TOKEN_RE + "') AS t FROM documents) y), "
    "idl AS (SELECT pt.doc_id, list(CAST(coalesce(v.term_id + 2, 1) AS INTEGER) ORDER BY pt.i) AS input_ids "
    "FROM pt LEFT JOIN v USING (token) GROUP BY pt.doc_id), "
    "ids AS (SELECT d.doc_id, coalesce(idl.input_ids, CAST([] AS INTEGER[])) AS input_ids FROM documents d "
    "LEFT JOIN idl USING (doc_id))"
)
IDS_ALL = "WITH " + SPLIT + ", " + TOK + ", " + TRAIN_TC + ", " + VOCAB_IDS + ", " + IDS


def _words(prefix: str) -> str:
    """CTEs ``<p>c(doc_id, i, word, chosen)`` for the seeded 30 % word choice."""
    p = prefix
    return (
        p + "w0 AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '" + WS_RE + "'), lambda x: x <> '') "
        "AS words FROM documents), "
        + p + "w AS (SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS i, len(words) AS L FROM "
        + p + "w0), "
        + p + "h AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY md5('42:' || CAST(doc_id AS VARCHAR) "
        "|| ':' || CAST(i AS VARCHAR))) AS hr, greatest(1, floor(CAST(0.3 AS DOUBLE) * L)) AS n FROM " + p + "w), "
        + p + "c AS (SELECT doc_id, i, word, hr <= n AS chosen FROM " + p + "h)"
    )


def _swap(prefix: str) -> str:
    p = prefix
    return (
        _words(p) + ", "
        + p + "cr AS (SELECT doc_id, i, word, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k, "
        "count(*) OVER (PARTITION BY doc_id) AS m FROM " + p + "c WHERE chosen), "
        + p + "rot AS (SELECT a.doc_id, a.i, b.word FROM " + p + "cr a JOIN " + p + "cr b ON a.doc_id = b.doc_id "
        "AND b.k = (a.k % a.m) + 1), "
        + p + "o AS (SELECT c.doc_id, c.i, coalesce(r.word, c.word) AS word FROM " + p + "c c LEFT JOIN "
        + p + "rot r ON r.doc_id = c.doc_id AND r.i = c.i), "
        + p + "out AS (SELECT d.doc_id, coalesce(s.text, '') AS text FROM documents d LEFT JOIN "
        "(SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM " + p + "o GROUP BY doc_id) s USING (doc_id))"
    )


def _delete(prefix: str) -> str:
    p = prefix
    return (
        _words(p) + ", "
        + p + "out AS (SELECT d.doc_id, coalesce(s.text, '') AS text FROM documents d LEFT JOIN "
        "(SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM " + p + "c WHERE NOT chosen "
        "GROUP BY doc_id) s USING (doc_id))"
    )


def _pick_hash(key: str) -> str:
    return ("CAST(('0x' || substr(md5('42:' || CAST(" + key + " AS VARCHAR) || ':pick'), 1, 8)) AS BIGINT)")


def _batch(order: str, size: int) -> str:
    return "CAST(floor((row_number() OVER (ORDER BY " + order + ") - 1) / " + str(size) + ") AS BIGINT)"


NULLS = "'nan'"
LIAR_TEXT = ("concat_ws(' [SEP] ', coalesce(d.text, 'nan'), coalesce(d.source, 'nan'), coalesce(c.role, 'nan'), "
             + ", ".join([NULLS] * 3) + ", coalesce(CAST(l.quality AS VARCHAR), 'nan'), "
             "coalesce(CAST(l.toxic AS VARCHAR), 'nan'), " + ", ".join([NULLS] * 3)
             + ", coalesce(d.source, 'nan'))")

METRIC_LOG = ("log AS (SELECT CAST(user_id AS VARCHAR) AS run, event_type AS metric, event_id AS step, value "
              "FROM events)")

ORACLE.update({
    "batches": ("SELECT doc_id, CAST(floor(rn / 10) AS BIGINT) AS batch_id, CAST(rn % 10 AS INTEGER) AS pos_in_batch "
                "FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS rn FROM documents) x"),
    "batch_max_len": (
        "SELECT doc_id, batch_id, n_tokens, max(n_tokens) OVER (PARTITION BY batch_id) AS batch_max_len FROM "
        "(SELECT doc_id, CAST(len(regexp_extract_all(lower(text), '" + TOKEN_RE + "')) AS INTEGER) AS n_tokens, "
        + _batch("doc_id", 8) + " AS batch_id FROM documents) x"),
    "token_ids": IDS_ALL + " SELECT doc_id, input_ids FROM ids",
    "token_ids_hashed": IDS_ALL + " SELECT doc_id, input_ids FROM ids",
    "truncate_pad_mask": (
        IDS_ALL + ", tb AS (SELECT doc_id, " + _batch("doc_id", 8) + " AS batch_id, list_slice(input_ids, 1, 512) "
        "AS t FROM ids), tm AS (SELECT *, max(len(t)) OVER (PARTITION BY batch_id) AS m FROM tb) "
        "SELECT doc_id, batch_id, CAST(list_resize(t, m, 0) AS INTEGER[]) AS input_ids, "
        "CAST(list_transform(range(m), lambda j: CASE WHEN j < len(t) THEN 1 ELSE 0 END) AS INTEGER[]) "
        "AS attention_mask FROM tm"),
    "step_epoch_accuracy": (
        "WITH " + MEANS + ", e AS (SELECT vec_id, label, " + ARGMAX_L + " AS prediction, " + _batch("vec_id", 10)
        + " AS batch_id FROM lg) "
        "SELECT 'probe' AS run, batch_id, round(avg(CASE WHEN label = prediction THEN CAST(1 AS DOUBLE) "
        "ELSE CAST(0 AS DOUBLE) END), 6) AS accuracy, count(*) AS n, "
        "CASE WHEN grouping(batch_id) = 1 THEN 'epoch' ELSE 'step' END AS grain "
        "FROM e GROUP BY GROUPING SETS ((batch_id), ())"),
    "l2_normalise": ("SELECT vec_id, list_transform(" + NORM_E + ", lambda x: round(x, 6)) AS embedding FROM "
                     "(SELECT vec_id, " + E_D + " AS e FROM embeddings) x"),
    "cosine_in_batch": (
        "WITH b AS (SELECT vec_id, label, " + NORM_E + " AS z, " + _batch("vec_id", 10) + " AS batch_id FROM "
        "(SELECT vec_id, label, " + E_D + " AS e FROM embeddings) x) "
        "SELECT a.batch_id, a.vec_id AS a_pos, c.vec_id AS b_pos, a.label AS a_label, a.label = c.label AS same_label, "
        "round(list_dot_product(a.z, c.z), 6) AS sim FROM b a JOIN b c ON a.batch_id = c.batch_id "
        "AND a.vec_id <> c.vec_id"),
    "softmax_argmax": (
        "WITH " + MEANS + " SELECT vec_id, " + ARGMAX_L + " AS prediction, list_transform(l, lambda x: round(exp(x - list_max(l)) / "
        "list_sum(list_transform(l, lambda y: exp(y - list_max(l)))), 6)) AS probs FROM lg"),
    "cross_entropy": (
        "WITH " + MEANS + " SELECT round(avg(m + ln(list_sum(list_transform(l, lambda x: exp(x - m)))) - l[label + 1]), 6) "
        "AS cross_entropy, count(*) AS n FROM (SELECT label, l, list_max(l) AS m FROM lg) y"),
    "supcon_loss": (
        "WITH b AS (SELECT vec_id, label, " + NORM_E + " AS z, "
        + _batch("md5('42:' || CAST(vec_id AS VARCHAR)), vec_id", 10) + " AS batch_id FROM "
        "(SELECT vec_id, label, " + E_D + " AS e FROM embeddings) x), "
        "p AS (SELECT a.batch_id, a.vec_id AS i, a.label = c.label AS same, "
        "list_dot_product(a.z, c.z) / CAST(0.1 AS DOUBLE) AS s FROM b a JOIN b c ON a.batch_id = c.batch_id "
        "AND a.vec_id <> c.vec_id), "
        "pm AS (SELECT *, max(s) OVER (PARTITION BY batch_id, i) AS mx FROM p), "
        "per AS (SELECT batch_id, i, max(mx) + ln(sum(exp(s - mx))) AS lse, "
        "sum(CASE WHEN same THEN s ELSE 0 END) AS ps, sum(CASE WHEN same THEN 1 ELSE 0 END) AS np "
        "FROM pm GROUP BY batch_id, i), "
        "anchor AS (SELECT b.batch_id, CASE WHEN per.np > 0 THEN -(per.ps - per.np * per.lse) / per.np "
        "ELSE 0 END AS loss FROM b LEFT JOIN per ON per.batch_id = b.batch_id AND per.i = b.vec_id) "
        "SELECT batch_id, count(*) AS n, round(avg(coalesce(loss, 0)), 6) AS loss FROM anchor GROUP BY batch_id"),
    "embedding_union": (
        "SELECT 'vf' AS source, vec_id, 'vf' || CAST(label AS VARCHAR) AS label, " + E_D + " AS embedding "
        "FROM embeddings UNION ALL SELECT 'xf' AS source, vec_id, 'xf' || CAST(label AS VARCHAR) AS label, "
        "list_transform(" + NORM_E + ", lambda x: round(x, 6)) AS embedding FROM "
        "(SELECT vec_id, label, " + E_D + " AS e FROM embeddings) x"),
    "augment_swap": "WITH " + _swap("s") + " SELECT doc_id, text FROM sout",
    "augment_delete": "WITH " + _delete("d") + " SELECT doc_id, text FROM dout",
    "augment_pick": (
        "WITH " + QUOTES + ", c AS (SELECT conv_id, quote_1 AS anchor, list_filter([" + ", ".join(f"quote_{i}" for i in range(2, 11)) + "], "
        "lambda x: x IS NOT NULL) AS cands, " + _pick_hash("conv_id") + " AS h FROM q) "
        "SELECT conv_id, anchor, CASE WHEN len(cands) > 0 THEN cands[1 + (h % len(cands))] END AS pick FROM c"),
    "contrastive_pairs": (
        "WITH " + _swap("s") + ", " + _delete("d") + ", "
        "a AS (SELECT doc.doc_id, doc.lang AS label, doc.text, CASE WHEN " + _pick_hash("doc.doc_id")
        + " % 2 = 0 THEN sout.text ELSE dout.text END AS augmented, "
        + _batch("md5('42:' || CAST(doc.doc_id AS VARCHAR)), doc.doc_id", 5) + " AS batch_id "
        "FROM documents doc JOIN sout USING (doc_id) JOIN dout USING (doc_id)) "
        "SELECT doc_id, label, batch_id, 0 AS view, text FROM a UNION ALL "
        "SELECT doc_id, label, batch_id, 1 AS view, augmented AS text FROM a"),
    "translations_wide": (
        "SELECT doc_id, text, lang AS label, " + ", ".join(f"'[{g}] ' || text AS augmented_{g}" for g in
                                            ("en", "tl", "vi", "th", "zh")) + " FROM documents"),
    "translations_resumed": (
        "SELECT doc_id, text, lang AS label, " + ", ".join(f"'[{g}] ' || text AS augmented_{g}" for g in ("en", "tl", "vi", "th", "zh"))
        + ", CAST(0 AS BIGINT) AS sent_again FROM documents"),
    "csv_round_trip": "SELECT doc_id, text, lang FROM documents",
    "csv_split_quotes": "SELECT doc_id, text, lang FROM documents",
    "tsv_round_trip": "SELECT conv_id, turn, role, text FROM conversations",
    "liar_layout": (
        "SELECT d.doc_id AS id, d.lang AS label, " + LIAR_TEXT + " AS text FROM documents d "
        "LEFT JOIN (SELECT conv_id, role FROM conversations WHERE turn = 0) c ON c.conv_id = d.doc_id "
        "LEFT JOIN labels l ON l.doc_id = d.doc_id"),
    "embedding_export": ("SELECT 'vf' AS tag, vec_id AS key, CAST(label AS VARCHAR) AS label, embedding "
                         "FROM embeddings"),
    "metric_log_topk": (
        "WITH " + METRIC_LOG + ", r AS (SELECT *, row_number() OVER (PARTITION BY run, metric ORDER BY value DESC, "
        "step) AS rk FROM log) SELECT run, metric, step, value, CAST(rk AS INTEGER) AS rank, 'top' AS kind "
        "FROM r WHERE rk <= 2 UNION ALL SELECT l.run, l.metric, l.step, l.value, 0 AS rank, 'last' AS kind "
        "FROM log l JOIN (SELECT run, metric, max(step) AS step FROM log GROUP BY run, metric) m "
        "ON l.run = m.run AND l.metric = m.metric AND l.step = m.step"),
    "registry": (
        "SELECT 'benchmark_items' AS dataset, count(*) AS n_rows, CAST(1 AS BIGINT) AS n_labels, 1 AS num_classes "
        "FROM benchmark "
        "UNION ALL SELECT 'documents_lang', count(*), count(DISTINCT lang), 4 FROM documents "
        "UNION ALL SELECT 'documents_quality', count(*), count(DISTINCT l.quality), 2 FROM documents d "
        "JOIN labels l USING (doc_id)"),
    "score_batch": "WITH " + MEANS + " SELECT vec_id, " + ARGMAX_L + " AS prediction FROM lg",
    "score_from_text": (
        IDS_ALL + ", cut AS (SELECT doc_id, list_slice(input_ids, 1, 512) AS t FROM ids), "
        "lg AS (SELECT doc_id, list_transform([0, 1, 2, 3], lambda j: len(list_filter(t, lambda x: x % 4 = j)) "
        "* CAST(4 AS DOUBLE) / greatest(len(t), 1)) AS l FROM cut) "
        "SELECT doc_id, list_transform(l, lambda x: round(exp(x - list_max(l)) / "
        "list_sum(list_transform(l, lambda y: exp(y - list_max(l)))), 6)) AS probs, "
        "['de', 'en', 'es', 'fr'][" + ARGMAX_L + " + 1] AS prediction FROM lg"),
    "pool_sequences": (
        "WITH e AS (SELECT vec_id // 8 AS seq, vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), "
        "f AS (SELECT seq, count(*) AS n_states, arg_min(v, vec_id) AS e FROM e GROUP BY seq), "
        "m AS (SELECT seq, list(a ORDER BY j) AS mean FROM (SELECT seq, j, round(avg(x), 6) AS a FROM (SELECT seq, unnest(v) AS x, "
        "unnest(range(64)) AS j FROM e WHERE label <> 0) u GROUP BY seq, j) g GROUP BY seq) "
        "SELECT f.seq, n_states, list_transform(range(8), lambda i: round(list_sum(list_transform(range(64), lambda j: "
        "e[j + 1] * CAST(((i * 7 + j * 3) % 11 - 5) AS DOUBLE) / 10)), 6)) AS projected, mean FROM f LEFT JOIN m USING (seq)"),
    "pool_project": (
        "WITH f AS (SELECT label, CAST(arg_min(embedding, vec_id) AS DOUBLE[]) AS e FROM embeddings GROUP BY label) "
        "SELECT label, list_transform(range(8), lambda i: round(list_sum(list_transform(range(64), lambda j: "
        "e[j + 1] * CAST(((i * 7 + j * 3) % 11 - 5) AS DOUBLE) / 10)), 6)) AS projected FROM f"),
    "embedding_tsv_pair": ("SELECT vec_id AS key, CAST(label AS VARCHAR) AS label, list_transform(CAST(embedding AS DOUBLE[]), "
                           "lambda x: round(x, 6)) AS embedding FROM embeddings"),
    "workbook_quotes": (
        "WITH " + QUOTES + " SELECT conv_id, ['FALSE', 'FAKE', 'MISLEADING', 'TRUE'][CAST(conv_id % 4 + 1 AS INTEGER)] AS rating, "
        "concat_ws(' ', " + ", ".join(f"coalesce(quote_{i}, '')" for i in range(1, 11)) + ") AS text FROM q WHERE conv_id % 4 <> 3"),
    "csv_by_name": "SELECT doc_id, lang FROM documents",
    "encode_fixed_map": ("SELECT doc_id, lang, CAST(CASE lang WHEN 'en' THEN 0 WHEN 'de' THEN 1 WHEN 'fr' THEN 2 "
                         "WHEN 'es' THEN 3 END AS INTEGER) AS label_id FROM documents"),
    "split_null_label": (
        "SELECT doc_id, label, " + SPLIT_CASE + " AS split FROM (SELECT d.doc_id, l.quality AS label, "
        "row_number() OVER (PARTITION BY l.quality ORDER BY md5('42:' || CAST(d.doc_id AS VARCHAR)), d.doc_id) - 1 AS rk, "
        "count(*) OVER (PARTITION BY l.quality) AS n FROM documents d LEFT JOIN labels l USING (doc_id)) s0"),
    "nb_confusion_classes": (
        NB_TF + ", ax AS (SELECT unnest(['de', 'en', 'es', 'fr', 'other']) AS c), "
        "cnt AS (SELECT label, prediction, count(*) AS n FROM res GROUP BY label, prediction) "
        "SELECT a.c AS label, b.c AS prediction, coalesce(cnt.n, 0) AS n FROM ax a CROSS JOIN ax b "
        "LEFT JOIN cnt ON cnt.label = a.c AND cnt.prediction = b.c"),
    "linear_probe": (
        "SELECT CAST(sum(n - ceil(CAST(0.3 AS DOUBLE) * n)) AS BIGINT) AS n, TRUE AS loss_below_guessing, "
        "TRUE AS gradient_near_zero FROM (SELECT count(*) AS n FROM embeddings GROUP BY label) c"),
    "model_round_trip": (
        "SELECT vec_id, TRUE AS same FROM (SELECT vec_id, row_number() OVER (PARTITION BY label ORDER BY "
        "md5('42:' || CAST(vec_id AS VARCHAR)), vec_id) - 1 AS rk, count(*) OVER (PARTITION BY label) AS n FROM embeddings) s "
        "WHERE rk < " + N_TEST),
    **{name: ("SELECT CAST(sum(" + N_TEST + ") AS BIGINT) AS n, TRUE AS beats_majority, TRUE AS gap_within_percent FROM "
              "(SELECT count(*) AS n FROM documents GROUP BY lang) c")
       for name in ("linear_svm", "svm_tfidf", "rff_svm", "rff_svm_counts", "kernel_svm")},
    "kernel_svm_saved": (
        "SELECT doc_id, TRUE AS same FROM (SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY "
        "md5('42:' || CAST(doc_id AS VARCHAR)), doc_id) - 1 AS rk, count(*) OVER (PARTITION BY lang) AS n FROM documents) s "
        "WHERE rk < " + N_TEST),
})

SPLIT_QUALITY = (
    "split AS (SELECT doc_id, label, " + SPLIT_CASE + " AS split FROM ("
    " SELECT d.doc_id, l.quality AS label,"
    " row_number() OVER (PARTITION BY l.quality ORDER BY md5('42:' || CAST(d.doc_id AS VARCHAR)), d.doc_id) - 1 AS rk,"
    " count(*) OVER (PARTITION BY l.quality) AS n FROM documents d JOIN labels l USING (doc_id)) s0)"
)
ORACLE["nb_quality_metrics"] = "WITH " + SPLIT_QUALITY + ", " + TOK + ", " + _nb("tf", "tc", "tc") + METRICS
