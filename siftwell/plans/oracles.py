"""Common table expressions from which the oracles are put together (DuckDB)."""

from __future__ import annotations

RECORDS = """
w AS (SELECT *, list_filter(string_split(lower(coalesce(text, '')), ' '), lambda x: x <> '') AS w FROM documents),
rec AS MATERIALIZED (SELECT doc_id, n_chars AS min_side, CASE WHEN len(w) > 0 THEN 100.0::DOUBLE * len(list_distinct(w)) / len(w) ELSE 0.0 END AS blur, lang AS cls,
  (substr(source, 4)::INT % 7)::INT AS cls7, source AS subclass, lang || '_' || source || '_' || least(n_chars // 1000, 5) AS raw_sig, least(n_chars // 1000, 5)::VARCHAR AS sig_b, w FROM w),
good AS MATERIALIZED (SELECT * FROM rec WHERE min_side >= 200 AND blur >= 25)"""

SOURCED = f"""{RECORDS},
s1 AS (SELECT *, count(*) OVER (PARTITION BY cls, raw_sig) AS n_sig, count(*) OVER (PARTITION BY cls) AS n_cls FROM good),
sourced AS MATERIALIZED (SELECT *, CASE WHEN n_sig >= greatest(2, floor(n_cls * 0.02::DOUBLE)) THEN raw_sig ELSE 'misc' END AS source FROM s1)"""

_BITS = ", ".join(f"sum(((v >> {i}::UBIGINT) & 1::UBIGINT)::BIGINT * 2 - 1) AS s{i}" for i in range(64))
_HASH = " + ".join(f"(CASE WHEN s{i} > 0 THEN {1 << i}::UBIGINT ELSE 0::UBIGINT END)" for i in range(64))
HASHED = f"""{RECORDS},
t AS (SELECT doc_id, unnest(w) AS token FROM rec),
sums AS (SELECT doc_id, {_BITS} FROM (SELECT doc_id, ('0x' || substr(md5(token), 1, 16))::UBIGINT AS v FROM t) GROUP BY doc_id),
hashed AS MATERIALIZED (SELECT rec.doc_id, coalesce({_HASH}, 0::UBIGINT) AS h FROM rec LEFT JOIN sums USING (doc_id))"""


def edges(source: str, cap: int = 500, whole: bool = False) -> str:
    bounds = [(64 * b // 6, 64 * (b + 1) // 6 - 64 * b // 6) if whole else (10 * b, 10) for b in range(6)]
    spread = " UNION ALL ".join(f"SELECT doc_id, h, {b} AS band, (h >> {lo}::UBIGINT) & {(1 << width) - 1}::UBIGINT AS key FROM hashed SEMI JOIN {source} USING (doc_id)" for b, (lo, width) in enumerate(bounds))
    return f"""{HASHED},
spread AS ({spread}),
kept AS MATERIALIZED (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY band, key) AS n FROM spread) WHERE n BETWEEN 2 AND {cap}),
pairs AS MATERIALIZED (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b, bit_count(xor(x.h, y.h))::INT AS hamming FROM kept x JOIN kept y ON x.band = y.band AND x.key = y.key AND x.doc_id < y.doc_id),
edges AS MATERIALIZED (SELECT * FROM pairs WHERE hamming <= 5)"""


def groups(source: str) -> str:
    return f"""{edges(source)},
sym AS MATERIALIZED (SELECT a, b FROM edges UNION ALL SELECT b, a FROM edges),
reach(doc_id, root) AS (SELECT doc_id, doc_id FROM {source} UNION SELECT e.b, r.root FROM reach r JOIN sym e ON e.a = r.doc_id),
grp AS MATERIALIZED (SELECT doc_id, min(root) AS group_id FROM reach GROUP BY doc_id)"""


GROUPED = f"{groups('good')}, grouped AS MATERIALIZED (SELECT good.*, group_id FROM good JOIN grp USING (doc_id))"


def policy(name: str, cls: str) -> str:
    order = f"min_side DESC, blur DESC, {cls}, doc_id"
    single = f"SELECT doc_id, group_id FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY {order}) AS k FROM m WHERE NOT mixed) WHERE k = 1"
    each = f"SELECT doc_id, group_id, {cls} FROM (SELECT *, row_number() OVER (PARTITION BY group_id, {cls} ORDER BY {order}) AS k FROM m WHERE mixed) WHERE k = 1"
    tail = {
        "drop_all": "",
        "report": f" UNION ALL SELECT doc_id, group_id FROM ({each})",
        "keep_rarest": f""" UNION ALL SELECT doc_id, group_id FROM (SELECT e.*, row_number() OVER (PARTITION BY group_id ORDER BY s.n, {cls}, doc_id) AS k
          FROM ({each}) e JOIN (SELECT {cls}, count(*) AS n FROM m GROUP BY {cls}) s USING ({cls})) WHERE k = 1""",
    }[name]
    return f"""WITH RECURSIVE {GROUPED},
m AS (SELECT *, min({cls}) OVER (PARTITION BY group_id) <> max({cls}) OVER (PARTITION BY group_id) AS mixed FROM grouped)
{single}{tail}"""


def _quota(target: int, cls: str, tag: str) -> str:
    return f"""strata{tag} AS MATERIALIZED (SELECT doc_id, blur, subclass || '||' || source AS stratum FROM sourced WHERE cls = '{cls}'),
q0{tag} AS (SELECT stratum, count(*) AS n, sum(count(*)) OVER () AS total FROM strata{tag} GROUP BY stratum),
q1{tag} AS (SELECT *, round_even({target}::DOUBLE * n / total, 0)::BIGINT AS q FROM q0{tag}),
q2{tag} AS (SELECT *, {target} - sum(q) OVER () AS diff FROM q1{tag}),
q3{tag} AS (SELECT *, sign(diff)::BIGINT AS step, q + sign(diff) BETWEEN 0 AND n AS room FROM q2{tag}),
q4{tag} AS (SELECT *, row_number() OVER (PARTITION BY room ORDER BY n DESC, stratum) AS k FROM q3{tag}),
quota{tag} AS MATERIALIZED (SELECT stratum, n, CASE WHEN total <= {target} THEN n ELSE q + CASE WHEN room AND k <= abs(diff) THEN step ELSE 0 END END::BIGINT AS quota FROM q4{tag})"""


def _sample(target: int, cls: str, tag: str) -> str:
    return f"""{_quota(target, cls, tag)},
p1{tag} AS (SELECT s.*, n, quota, row_number() OVER (PARTITION BY s.stratum ORDER BY blur DESC, doc_id) AS k FROM strata{tag} s JOIN quota{tag} USING (stratum)),
p2{tag} AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5(doc_id || ':42'), doc_id) AS r FROM p1{tag} WHERE k <= greatest(quota, floor(n * 0.7::DOUBLE))),
sampled{tag} AS MATERIALIZED (SELECT doc_id, stratum FROM p2{tag} WHERE r <= quota)"""


def quota(target: int) -> str:
    return f"{SOURCED},\n{_quota(target, 'en', '')}"


def sample(target: int) -> str:
    return f"{SOURCED},\n{_sample(target, 'en', '')}"


def samples(targets: dict[str, int]) -> str:
    """Sampled rows of each class with a target, as sampled_<class>."""
    parts = [_sample(n, cls, f"_{cls}") for cls, n in targets.items()]
    return ",\n".join([SOURCED, *parts])


_LABELLED = f"{GROUPED}, grouped_l AS MATERIALIZED (SELECT doc_id, group_id, cls7 AS label, subclass AS source FROM grouped)"


def _folds(name: str, source: str, folds: int, seed: int) -> str:
    return f"""{name}_c AS (SELECT group_id, label, count(*) AS c FROM {source} GROUP BY ALL),
{name}_g AS (SELECT group_id, sum(c) AS size, (arg_min(label, (-c, label))) AS main FROM {name}_c GROUP BY group_id),
{name} AS MATERIALIZED (SELECT group_id, ((row_number() OVER (PARTITION BY main ORDER BY size DESC, md5(group_id || ':{seed}'), group_id) - 1) % {folds})::INT AS fold FROM {name}_g)"""


SPLIT = f"""{_LABELLED},
{_folds("f1", "grouped_l", 7, 42)},
left_over AS MATERIALIZED (SELECT g.* FROM grouped_l g JOIN f1 USING (group_id) WHERE fold <> 0),
{_folds("f2", "left_over", 6, 43)},
split AS MATERIALIZED (SELECT g.*, CASE WHEN f1.fold = 0 THEN 'test' WHEN f2.fold = 0 THEN 'val' ELSE 'train' END AS split FROM grouped_l g JOIN f1 USING (group_id) LEFT JOIN f2 USING (group_id))"""

KFOLD = f"""{_LABELLED},
{_folds("f1", "grouped_l", 5, 42)},
kfold AS (SELECT k.fold, CASE WHEN k.fold = f1.fold THEN 'val' ELSE 'train' END AS role FROM grouped_l JOIN f1 USING (group_id), (SELECT range::INT AS fold FROM range(5)) k)"""

KFOLD_TEST = f"""{_LABELLED},
{_folds("f1", "grouped_l", 7, 42)},
left_over AS MATERIALIZED (SELECT g.* FROM grouped_l g JOIN f1 USING (group_id) WHERE fold <> 0),
{_folds("f2", "left_over", 4, 43)},
kfold AS (SELECT k.fold, CASE WHEN f1.fold = 0 THEN 'test' WHEN k.fold = f2.fold THEN 'val' ELSE 'train' END AS role
  FROM grouped_l JOIN f1 USING (group_id) LEFT JOIN f2 USING (group_id), (SELECT range::INT AS fold FROM range(4)) k)"""

def balanced(folds: int, seed: int, labels: int = 7) -> str:
    """Rows of each fold and label: groups of a kind are dealt evenly, the odd ones one by one to where labels' shares then deviate least."""
    every = f"range(1, {folds + 1})"
    share = f"(w.held[g][x] + CASE WHEN g = f THEN u.v[x] ELSE 0 END) / greatest(1, tt.t[x])"
    off = f"round(list_aggregate(list_transform(range(1, {labels + 1}), lambda x: list_aggregate(list_transform({every}, lambda g: {share}), 'stddev_pop')), 'avg'), 12)"
    best = f"list_min(list_transform({every}, lambda f: [{off}, list_sum(w.held[f]), f]))[3]::INT"
    return f"""{_LABELLED},
cells AS (SELECT group_id, label, count(*) AS c FROM grouped_l GROUP BY ALL),
vec AS (SELECT group_id, '[' || string_agg('{{"l":"{{\\"l\\":' || label || '}}","c":' || c || '}}', ',' ORDER BY label) || ']' AS kind,
  list_transform(range({labels}), lambda x: coalesce(list_sum(list_transform(list_filter(list({{'l': label, 'c': c}}), lambda y: y.l = x), lambda y: y.c)), 0)::DOUBLE) AS v FROM cells GROUP BY group_id),
ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY md5(group_id || ':{seed}'), group_id) - 1 AS turn, count(*) OVER (PARTITION BY kind) AS m FROM vec),
totals AS MATERIALIZED (SELECT list(t ORDER BY x) AS t FROM (SELECT x, sum(v[x]) AS t FROM ranked, (SELECT range AS x FROM range(1, {labels + 1})) GROUP BY x)),
units AS MATERIALIZED (SELECT kind, turn, v, row_number() OVER (ORDER BY (SELECT count(DISTINCT label) FROM cells) * list_sum(list_transform(v, lambda y: y * y)) - list_sum(v) * list_sum(v) DESC, list_sum(v) DESC, kind, turn) AS i
  FROM ranked WHERE turn >= m - m % {folds}),
walk(i, kind, turn, fold, held) AS (
  SELECT 0::BIGINT, NULL::VARCHAR, NULL::BIGINT, 0, list_transform({every}, lambda f: list_transform(range({labels}), lambda x: 0.0::DOUBLE))
  UNION ALL SELECT i, kind, turn, fold, list_transform({every}, lambda f: CASE WHEN f = fold THEN list_transform(range(1, {labels + 1}), lambda x: held[f][x] + v[x]) ELSE held[f] END)
    FROM (SELECT u.i, u.kind, u.turn, u.v, w.held, {best} AS fold FROM walk w JOIN units u ON u.i = w.i + 1, totals tt)),
dealt AS (SELECT r.group_id, (coalesce(w.fold - 1, r.turn % {folds}))::INT AS fold FROM ranked r LEFT JOIN walk w ON w.kind = r.kind AND w.turn = r.turn)"""


HOLDOUT = f"""{_LABELLED},
h0 AS (SELECT label, source, count(*) AS n FROM grouped_l WHERE source <> '-' GROUP BY ALL),
h1 AS (SELECT label, count(*) AS total FROM grouped_l GROUP BY label),
h2 AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n, source) AS r, sum(n) OVER (PARTITION BY label ORDER BY n, source ROWS UNBOUNDED PRECEDING) - n AS c,
  count(*) OVER (PARTITION BY label) AS sources, greatest(1, floor(0.15::DOUBLE * total)) AS want FROM h0 JOIN h1 USING (label)),
held AS MATERIALIZED (SELECT label, source, n FROM h2 WHERE sources >= 2 AND c < want AND n <= 0.5::DOUBLE * total AND (r = 1 OR c + n <= 1.4::DOUBLE * want))"""

CLOSURE = f"""{HOLDOUT},
held_rows AS MATERIALIZED (SELECT doc_id, label FROM grouped_l SEMI JOIN held USING (label, source)),
n1 AS (SELECT label, total, coalesce((SELECT count(*) FROM held_rows r WHERE r.label = h1.label), 0) AS have FROM h1),
n2 AS (SELECT *, floor(0.15::DOUBLE * total) - have AS need FROM n1),
n3 AS (SELECT label, least(need, greatest(1, total - have - 1)) AS take FROM n2 WHERE need > 0 AND total > have),
top_up AS (SELECT doc_id FROM (SELECT doc_id, take, row_number() OVER (PARTITION BY label ORDER BY md5(doc_id || ':42'), doc_id) AS r
  FROM grouped_l JOIN n3 USING (label) WHERE doc_id NOT IN (SELECT doc_id FROM held_rows)) WHERE r <= take),
chosen AS (SELECT doc_id FROM held_rows UNION ALL SELECT doc_id FROM top_up),
chosen_groups AS MATERIALIZED (SELECT DISTINCT group_id FROM grouped_l SEMI JOIN chosen USING (doc_id))"""

PREDICTIONS = """
e AS (SELECT vec_id, label, list_transform(list_slice(embedding, 1, 7), lambda x: exp(8.0::DOUBLE * x::DOUBLE)) AS e FROM embeddings),
q AS (SELECT vec_id, label, list_transform(e, lambda x: round(x / list_aggregate(e, 'sum'), 6)) AS probs FROM e),
p AS MATERIALIZED (SELECT vec_id AS id, (label % 7)::INT AS label, (list_position(probs, list_max(probs)) - 1)::INT AS prediction, list_max(probs) AS conf, 'src' || (vec_id % 5) AS source, probs FROM q)"""

SCORES = f"""{PREDICTIONS}, k AS (SELECT range::INT AS label FROM range(7)),
per AS (SELECT label, (SELECT count(*) FROM p WHERE p.label = k.label) AS support, (SELECT count(*) FROM p WHERE p.prediction = k.label) AS predicted,
  (SELECT count(*) FROM p WHERE p.prediction = k.label AND p.label = k.label) AS tp FROM k),
scores AS MATERIALIZED (SELECT *, coalesce(tp::DOUBLE / nullif(predicted, 0), 0.0) AS precision, coalesce(tp::DOUBLE / nullif(support, 0), 0.0) AS recall,
  coalesce(2.0::DOUBLE * tp / nullif(predicted + support, 0), 0.0) AS f1 FROM per)"""

REPORT = f"""WITH {SCORES}, r AS (
SELECT label::VARCHAR AS name, precision, recall, f1, support FROM scores
UNION ALL SELECT 'accuracy', sum(tp)::DOUBLE / sum(support), sum(tp)::DOUBLE / sum(support), sum(tp)::DOUBLE / sum(support), sum(support) FROM scores
UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM scores
UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM scores)
SELECT name, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support::BIGINT AS support FROM r"""


def roc(micro: bool) -> str:
    cls = "-1" if micro else "i - 1"
    return f"""{PREDICTIONS},
scored AS (SELECT ({cls})::INT AS cls, probs[i] AS score, (label = i - 1)::INT AS pos FROM p, (SELECT range AS i FROM range(1, 8))),
by_score AS (SELECT cls, score, sum(pos) AS p, count(*) AS c FROM scored GROUP BY ALL),
tot AS (SELECT cls, sum(p) AS np, sum(c - p) AS nn FROM by_score GROUP BY cls HAVING sum(p) > 0 AND sum(c - p) > 0),
run AS (SELECT cls, score AS threshold, sum(p) OVER d AS tp, sum(c - p) OVER d AS fp, np, nn FROM by_score JOIN tot USING (cls) WINDOW d AS (PARTITION BY cls ORDER BY score DESC ROWS UNBOUNDED PRECEDING)
  UNION ALL SELECT cls, NULL, 0, 0, np, nn FROM tot),
roc AS MATERIALIZED (SELECT cls, threshold, tp::BIGINT AS tp, fp::BIGINT AS fp, fp::DOUBLE / nn AS fpr, tp::DOUBLE / np AS tpr FROM run)"""


AREA = """steps AS (SELECT cls, fpr, tpr, lag(fpr) OVER o AS px, lag(tpr) OVER o AS py FROM roc WINDOW o AS (PARTITION BY cls ORDER BY fpr, tpr)),
area AS (SELECT cls, sum((fpr - px) * (tpr + py) / 2) AS auc FROM steps GROUP BY cls)"""

MEAN_ROC = f"""{roc(False)},
curve AS (SELECT cls, fpr, max(tpr) AS tpr FROM roc GROUP BY ALL),
grid AS (SELECT c.cls, g.fpr FROM (SELECT DISTINCT fpr FROM curve) g, (SELECT DISTINCT cls FROM curve) c),
lo AS (SELECT g.cls, g.fpr, c.fpr AS x0, c.tpr AS y0 FROM grid g ASOF JOIN curve c ON g.cls = c.cls AND g.fpr >= c.fpr),
near AS (SELECT l.*, c.fpr AS x1, c.tpr AS y1 FROM lo l ASOF JOIN curve c ON l.cls = c.cls AND l.fpr <= c.fpr),
mean AS (SELECT fpr, avg(y0 + coalesce((fpr - x0) / nullif(x1 - x0, 0), 0.0) * (y1 - y0)) AS tpr FROM near GROUP BY fpr)"""

MACRO_AUC = f"""WITH {MEAN_ROC},
st AS (SELECT fpr, tpr, lag(fpr) OVER (ORDER BY fpr, tpr) AS px, lag(tpr) OVER (ORDER BY fpr, tpr) AS py FROM mean)
SELECT round(sum((fpr - px) * (tpr + py) / 2), 8) AS auc FROM st"""


def _lloyd(rounds: int) -> str:
    parts = ["v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS f FROM embeddings)", "c0 AS (SELECT id::INT AS cluster, f AS centre FROM v WHERE id < 8)"]
    near = "SELECT id, f, cluster, d2 FROM (SELECT v.id, v.f, c.cluster, list_sum(list_transform(list_zip(v.f, c.centre), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d2, row_number() OVER (PARTITION BY v.id ORDER BY d2, c.cluster) AS k FROM v, c{r} c) WHERE k = 1"
    for r in range(rounds):
        parts.append(f"n{r} AS MATERIALIZED ({near.format(r=r)})")
        parts.append(f"x{r} AS (SELECT cluster, i, avg(f[i]) AS m FROM n{r}, (SELECT range AS i FROM range(1, 65)) GROUP BY ALL)")
        parts.append(f"c{r + 1} AS MATERIALIZED (SELECT cluster, coalesce(moved, centre) AS centre FROM c{r} LEFT JOIN (SELECT cluster, list(m ORDER BY i) AS moved FROM x{r} GROUP BY cluster) USING (cluster))")
    return f"WITH {', '.join(parts)}, last AS ({near.format(r=rounds)}) SELECT id, cluster, round(d2, 6) AS d2 FROM last"


LLOYD = _lloyd(2)


def training(folds: int, own: str, plan) -> str:
    """The runs of ``classifier.trained`` on the embeddings, step by step; ``own``: a row's fold. Ends with history (run, epoch, ...) and tested (run, epoch, acc, f1)."""
    parts = [
        f"x AS MATERIALIZED (SELECT vec_id AS id, (label % 7)::INT AS label, ({own})::INT AS own, list_append(list_transform(embedding, lambda v: v::DOUBLE), 1.0::DOUBLE) AS f FROM embeddings)",
        f"r AS (SELECT a.range::INT AS run, b.range::INT AS cls FROM range({folds}) a, range(7) b)",
        "n AS (SELECT run, cls, greatest(1, count(x.id)) AS n FROM r LEFT JOIN x ON x.label = cls AND own >= 0 AND own <> run GROUP BY ALL)",
        f"soft AS (SELECT run, cls, pow(sum(n) OVER (PARTITION BY run) / (7.0::DOUBLE * n), {plan.beta}::DOUBLE) AS raw FROM n)",
        "cw AS MATERIALIZED (SELECT run, cls AS label, raw / avg(raw) OVER (PARTITION BY run) AS cw FROM soft)",
        "w0 AS MATERIALIZED (SELECT run, cls, list_append(list_transform(range(64), lambda i: 0.0::DOUBLE), -1e-6::DOUBLE * cls) AS w FROM r)",
    ]
    for s in range(plan.epochs + 1):
        head, backbone = plan.rates(s)
        parts += [
            f"z{s} AS (SELECT run, id, own, label, cls, list_dot_product(f, w) AS z FROM x, w{s})",
            f"e{s} AS (SELECT *, exp(z - max(z) OVER (PARTITION BY run, id)) AS e FROM z{s})",
            f"p{s} AS MATERIALIZED (SELECT run, id, own, label, cls, e / sum(e) OVER (PARTITION BY run, id) AS p FROM e{s})",
            f"said{s} AS MATERIALIZED (SELECT run, id, own, label, arg_max(cls, (p, -cls)) AS said, max(p) FILTER (cls = label) AS mine FROM p{s} GROUP BY ALL)",
            f"sums{s} AS (SELECT run, sum(-ln(mine) * cw) FILTER (own >= 0 AND own <> run) / sum(cw) FILTER (own >= 0 AND own <> run) AS train_loss, avg((said = label)::INT) FILTER (own >= 0 AND own <> run) AS train_acc, sum(-ln(mine) * cw) FILTER (own = run) / sum(cw) FILTER (own = run) AS val_loss, avg((said = label)::INT) FILTER (own = run) AS val_acc, avg((said = label)::INT) FILTER (own = -1) AS test_acc FROM said{s} JOIN cw USING (run, label) GROUP BY run)",
            f"""f{s} AS (SELECT run, avg(f1) FILTER (v) AS val_f1, avg(f1) FILTER (NOT v) AS test_f1 FROM (SELECT run, v, cls, 2.0::DOUBLE * sum((label = cls AND said = cls)::INT) / sum((label = cls)::INT + (said = cls)::INT) AS f1
              FROM (SELECT *, own = run AS v FROM said{s} WHERE own = run OR own = -1), (SELECT range::INT AS cls FROM range(7)) GROUP BY ALL HAVING sum((label = cls)::INT + (said = cls)::INT) > 0) GROUP BY run)""",
        ]
        if s < plan.epochs:
            parts += [
                f"g{s} AS (SELECT run, cls, i, sum(cw * (p - (label = cls)::INT) * f[i]) / sum(cw) AS g FROM p{s} JOIN x USING (id, own, label) JOIN cw USING (run, label), (SELECT range AS i FROM range(1, 66)) WHERE own >= 0 AND own <> run GROUP BY ALL)",
                f"w{s + 1} AS MATERIALIZED (SELECT run, cls, list(w[i] - (CASE WHEN i = 65 THEN {head!r}::DOUBLE ELSE {backbone!r}::DOUBLE END) * g ORDER BY i) AS w FROM w{s} JOIN g{s} USING (run, cls) GROUP BY run, cls)",
            ]
    rows = " UNION ALL ".join(
        f"SELECT a.run, {s + 1} AS epoch, {str(s < plan.freeze).lower()} AS frozen, {plan.rates(s)[0]!r}::DOUBLE AS lr_head, {plan.rates(s)[1]!r}::DOUBLE AS lr_backbone, a.train_loss, a.train_acc, b.val_loss, b.val_acc, c.val_f1 AS val_macro_f1, b.test_acc, c.test_f1 FROM sums{s} a JOIN sums{s + 1} b USING (run) JOIN f{s + 1} c USING (run)"
        for s in range(plan.epochs)
    )
    return ",\n".join([*parts, f"history AS MATERIALIZED ({rows})"])


def k_means(rounds: int, seed: int = 42, most: int = 20) -> str:
    """Labels after k-means from hash draws in proportion to squared distances; rounds after the labels stand still change nothing."""
    d2 = "list_sum(list_transform(list_zip(v.f, c.centre), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    wait = lambda j: f"-ln((('0x' || substr(md5(id || ':{seed}:{j}'), 1, 13))::UBIGINT::DOUBLE + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)"
    parts = [
        "v AS MATERIALIZED (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS f FROM embeddings)",
        f"k AS (SELECT greatest(1, least({most}, count(*) // 20)) AS k FROM v)",
        f"s0 AS MATERIALIZED (SELECT 0 AS cluster, arg_min(f, ({wait(0)}, id)) AS centre FROM v)",
    ]
    for j in range(1, most):
        parts.append(f"d{j} AS (SELECT v.id, any_value(v.f) AS f, min({d2}) AS d2 FROM v, s{j - 1} c GROUP BY v.id)")
        parts.append(f"s{j} AS MATERIALIZED (SELECT * FROM s{j - 1} UNION ALL SELECT {j}, f FROM (SELECT arg_min(f, (d2 <= 0, CASE WHEN d2 > 0 THEN {wait(j)} / d2 ELSE {wait(j)} END, id)) AS f FROM d{j}), k WHERE {j} < k)")
    parts.append(f"c0 AS (SELECT cluster, centre FROM s{most - 1})")
    near = f"SELECT id, f, cluster FROM (SELECT v.id, v.f, c.cluster, row_number() OVER (PARTITION BY v.id ORDER BY {d2}, c.cluster) AS n FROM v, c{{r}} c) WHERE n = 1"
    for r in range(rounds - 1):
        parts.append(f"n{r} AS MATERIALIZED ({near.format(r=r)})")
        parts.append(f"x{r} AS (SELECT cluster, i, avg(f[i]) AS m FROM n{r}, (SELECT range AS i FROM range(1, 65)) GROUP BY ALL)")
        parts.append(f"c{r + 1} AS MATERIALIZED (SELECT cluster, coalesce(moved, centre) AS centre FROM c{r} LEFT JOIN (SELECT cluster, list(m ORDER BY i) AS moved FROM x{r} GROUP BY cluster) USING (cluster))")
    return f"WITH {', '.join(parts)}, last AS ({near.format(r=rounds - 1)}) SELECT id, printf('c%02d', cluster) AS vcluster FROM last"
