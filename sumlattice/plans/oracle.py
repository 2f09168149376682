"""The same statistics in plain SQL, written out on its own for each query."""

from __future__ import annotations

from collections.abc import Sequence

from ..functions.combos import enumerate_combinations
from ..functions.intervals import normal_quantile


def frequencies(rows: str, items: Sequence[str], low: int, high: int, keys: Sequence[str] = (), times: str = "1") -> str:
    """CTEs up to ``freq`` (keys, combo_id, n_items, items, score, p, n); a row stands for ``times`` rows."""
    lines = []
    for rank, c in enumerate(enumerate_combinations(len(items), low, high)):
        marks = ", ".join(str(int(i in c)) for i in range(len(items)))
        lines.append(f"({rank}, {len(c)}, '{', '.join(items[i] for i in c)}', {marks})")
    marks = ", ".join(f"m{i}" for i in range(len(items)))
    score = " + ".join(f"CAST({x} AS DOUBLE) * m{i}" for i, x in enumerate(items))
    by = "".join(f"{k}, " for k in keys)
    return f"""src AS ({rows}),
cand(combo_id, n_items, items, {marks}) AS (VALUES {', '.join(lines)}),
freq AS (SELECT {by}CAST(combo_id AS BIGINT) AS combo_id, n_items, items, {score} AS score, CAST(sum(y * {times}) AS BIGINT) AS p, CAST(sum((1 - y) * {times}) AS BIGINT) AS n
  FROM src CROSS JOIN cand GROUP BY ALL)"""


def tables(freq: str, keys: Sequence[str], carry: Sequence[str] = (), prefix: str = "", method: str = "youden") -> str:
    """CTEs ``{prefix}roc`` (a row per cutoff) and ``{prefix}best`` (a row per key)."""
    k = ", ".join(keys)
    kc = ", ".join([*keys, *carry])
    order = "youden DESC, sensitivity DESC, specificity DESC, cutoff ASC" if method == "youden" else "sqrt((1.0 - sensitivity) * (1.0 - sensitivity) + (1.0 - specificity) * (1.0 - specificity)) ASC, youden DESC, cutoff DESC"
    return f"""{prefix}low AS (SELECT {kc}, score AS cutoff, p, n,
    CAST(sum(p) OVER (PARTITION BY {k}) AS BIGINT) AS n_positive, CAST(sum(n) OVER (PARTITION BY {k}) AS BIGINT) AS n_negative,
    CAST(coalesce(sum(p) OVER (PARTITION BY {k} ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS fn,
    CAST(coalesce(sum(n) OVER (PARTITION BY {k} ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS tn FROM {freq}),
{prefix}roc AS (SELECT *, {metrics()} FROM (SELECT *, n_positive - fn AS tp, n_negative - tn AS fp FROM {prefix}low)),
{prefix}best AS (SELECT * FROM (SELECT *, CAST(sum(CAST(p AS HUGEINT) * (2 * tn + n)) OVER (PARTITION BY {k}) AS DOUBLE) / (2.0::DOUBLE * n_positive::DOUBLE * n_negative::DOUBLE) AS auc,
    row_number() OVER (PARTITION BY {k} ORDER BY {order}) AS pick FROM {prefix}roc) WHERE pick = 1)"""


def metrics() -> str:
    div = lambda a, b: f"CASE WHEN {b} > 0 THEN ({a})::DOUBLE / ({b})::DOUBLE END"
    sens, spec = div("tp", "tp + fn"), div("tn", "tn + fp")
    return f"{sens} AS sensitivity, {spec} AS specificity, ({sens}) + ({spec}) - 1.0::DOUBLE AS youden, {div('tp + tn', 'tp + fp + fn + tn')} AS accuracy, {div('tp', 'tp + fp')} AS ppv, {div('tn', 'tn + fn')} AS npv"


SHOWN = "items, n_items, auc, cutoff, sensitivity, specificity, youden, accuracy, ppv, npv, n_positive, n_negative, combo_id"


def search(rows: str, items: Sequence[str], low: int, high: int, rank_by: str = "auc", top_n: int | None = 20, prefer_fewer: bool = True, method: str = "youden", where: str = "TRUE", order: str | None = None, times: str = "1") -> str:
    order = order or f"{rank_by} DESC NULLS LAST, {'n_items ASC, ' if prefer_fewer else ''}combo_id ASC"
    limit = f"WHERE rank <= {top_n}" if top_n is not None else ""
    return f"""WITH {frequencies(rows, items, low, high, times=times)}, {tables('freq', ['combo_id'], ['n_items', 'items'], method=method)}
SELECT * FROM (SELECT CAST(row_number() OVER (ORDER BY {order}) AS INTEGER) AS rank, {SHOWN} FROM best WHERE {where}) {limit}"""


def delong(rows: str, items: Sequence[str], low: int, high: int, level: float = 0.95) -> str:
    z = repr(normal_quantile(1 - (1 - level) / 2))
    return f"""WITH {frequencies(rows, items, low, high)},
place AS (SELECT combo_id, p, n, CAST(sum(p) OVER w AS HUGEINT) AS tp, CAST(sum(n) OVER w AS HUGEINT) AS tn,
    CAST(2 * coalesce(sum(n) OVER b, 0) + n AS HUGEINT) AS a, CAST(2 * (sum(p) OVER w - coalesce(sum(p) OVER b, 0)) - p AS HUGEINT) AS d FROM freq
    WINDOW w AS (PARTITION BY combo_id), b AS (PARTITION BY combo_id ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
sums AS (SELECT combo_id, max(tp) AS pp, max(tn) AS nn, CAST(sum(p * a) AS HUGEINT) AS s, CAST(sum(p * a * a) AS HUGEINT) AS s2, CAST(sum(n * d * d) AS HUGEINT) AS t2 FROM place GROUP BY combo_id),
var AS (SELECT combo_id, s::DOUBLE / (2.0::DOUBLE * pp::DOUBLE * nn::DOUBLE) AS auc,
    sqrt((pp * s2 - s * s)::DOUBLE / (4.0::DOUBLE * pp::DOUBLE * nn::DOUBLE * nn::DOUBLE * (pp::DOUBLE - 1)) / pp::DOUBLE
       + (nn * t2 - s * s)::DOUBLE / (4.0::DOUBLE * nn::DOUBLE * pp::DOUBLE * pp::DOUBLE * (nn::DOUBLE - 1)) / nn::DOUBLE) AS auc_se FROM sums)
SELECT combo_id, auc, auc_se, greatest(0.0::DOUBLE, auc - {z}::DOUBLE * auc_se) AS auc_lower, least(1.0::DOUBLE, auc + {z}::DOUBLE * auc_se) AS auc_upper FROM var"""


def final_fit(rows: str, items: Sequence[str], low: int, high: int, top_n: int, digits: int = 9, level: float = 0.95) -> str:
    """The best candidates with intervals; ends of exact ones by halving until a sum of binomial terms is the tail, once for each pair of counts."""
    shares = {"sensitivity": ("tp", "tp + fn"), "specificity": ("tn", "tn + fp"), "accuracy": ("tp + tn", "tp + fn + tn + fp"), "ppv": ("tp", "tp + fp"), "npv": ("tn", "tn + fn")}
    asked = " UNION ".join(f"SELECT {k} AS k, {n} AS n FROM top" for k, n in shares.values())
    term = "exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(x) + (n - i) * ln(1 - x))"
    # Sums from k on grow with x, those up to k fall: both ends are where the sum is the tail.
    above = f"list_sum(list_transform(range(k, n + 1), lambda i: {term}))"
    below = f"list_sum(list_transform(range(0, k + 1), lambda i: {term}))"
    show = ", ".join([f"round(d.{c}, {digits}) AS {c}" for c in ("auc", "auc_lower", "auc_upper")] + [f"round(t.{m}, {digits}) AS {m}, round({m}_e.low, {digits}) AS {m}_lower, round({m}_e.high, {digits}) AS {m}_upper" for m in shares])
    joins = " ".join(f"JOIN ends {m}_e ON {m}_e.k = {k} AND {m}_e.n = {n}" for m, (k, n) in shares.items())
    return f"""WITH RECURSIVE {frequencies(rows, items, low, high)}, {tables('freq', ['combo_id'], ['n_items', 'items'])},
top AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (ORDER BY auc DESC, n_items, combo_id) AS INTEGER) AS rank FROM best) WHERE rank <= {top_n}),
asked AS (SELECT k, n, upper FROM ({asked}) CROSS JOIN (VALUES (FALSE), (TRUE)) u(upper) WHERE n > 0 AND k > 0 AND k < n),
halving(k, n, upper, low, high, step) AS (SELECT k, n, upper, 0.0::DOUBLE, 1.0::DOUBLE, 0 FROM asked UNION ALL
  SELECT k, n, upper, CASE WHEN grows THEN x ELSE low END, CASE WHEN grows THEN high ELSE x END, step + 1 FROM (SELECT *, CASE WHEN upper THEN {below} > {(1 - level) / 2} ELSE {above} < {(1 - level) / 2} END AS grows FROM (SELECT *, (low + high) / 2 AS x FROM halving WHERE step < 42))),
found AS (SELECT k, n, upper, (low + high) / 2 AS x FROM halving WHERE step = 42),
ends AS (SELECT a.k, a.n, CASE WHEN a.k = 0 THEN 0.0 WHEN a.k = a.n THEN pow({(1 - level) / 2}, 1.0 / a.n) ELSE l.x END AS low, CASE WHEN a.k = a.n THEN 1.0 WHEN a.k = 0 THEN 1 - pow({(1 - level) / 2}, 1.0 / a.n) ELSE h.x END AS high
  FROM ({asked}) a LEFT JOIN found l ON l.k = a.k AND l.n = a.n AND NOT l.upper LEFT JOIN found h ON h.k = a.k AND h.n = a.n AND h.upper)
SELECT t.rank, t.items, t.n_items, {show}, t.cutoff, round(t.youden, {digits}) AS youden, t.n_positive, t.n_negative, t.combo_id
FROM top t JOIN ({delong(rows, items, low, high, level)}) d ON d.combo_id = t.combo_id {joins}"""


def weighted_delong(rows: str, items: Sequence[str], low: int, high: int, times: str) -> str:
    """AUC and its standard error in doubles about the mean, for counts whose squares no whole number of SQL holds."""
    return f"""WITH {frequencies(rows, items, low, high, times=times)},
place AS (SELECT combo_id, CAST(p AS DOUBLE) AS p, CAST(n AS DOUBLE) AS n, CAST(sum(p) OVER w AS DOUBLE) AS pp, CAST(sum(n) OVER w AS DOUBLE) AS nn,
    CAST(2 * coalesce(sum(n) OVER b, 0) + n AS DOUBLE) / 2 AS a, CAST(2 * (sum(p) OVER w - coalesce(sum(p) OVER b, 0)) - p AS DOUBLE) / 2 AS d FROM freq
    WINDOW w AS (PARTITION BY combo_id), b AS (PARTITION BY combo_id ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
mean AS (SELECT *, sum(p * a) OVER (PARTITION BY combo_id) / pp / nn AS auc FROM place)
SELECT combo_id, round(max(auc), 12) AS auc, round(1e9 * sqrt(sum(p * (a / nn - auc) * (a / nn - auc)) / (max(pp) - 1) / max(pp) + sum(n * (d / pp - auc) * (d / pp - auc)) / (max(nn) - 1) / max(nn)), 6) AS auc_se_billionths
FROM mean GROUP BY combo_id"""


def folds(rows: str, k: int, repeats: int, seed: int) -> str:
    """SELECT of the rows with ``repeat`` and ``fold``."""
    return f"""SELECT *, CAST(ntile({k}) OVER (PARTITION BY repeat, y ORDER BY md5(CAST({seed} + repeat - 1 AS VARCHAR) || '|' || CAST(row_id AS VARCHAR)), row_id) AS INTEGER) AS fold
  FROM ({rows}) CROSS JOIN (SELECT CAST(r AS INTEGER) AS repeat FROM range(1, {repeats + 1}) t(r))"""


def train_search(rows: str, items: Sequence[str], low: int, high: int, k: int, repeats: int, seed: int, method: str = "youden") -> str:
    """CTEs up to ``best``, a row per repeat, fold and candidate, from the training rows themselves."""
    f = frequencies(folds(rows, k, repeats, seed), items, low, high, ["repeat", "fold"])
    train = f"""train AS (SELECT repeat, o.fold AS fold, combo_id, n_items, items, score, CAST(sum(p) AS BIGINT) AS p, CAST(sum(n) AS BIGINT) AS n
  FROM freq CROSS JOIN (SELECT CAST(f AS INTEGER) AS fold FROM range(1, {k + 1}) t(f)) o WHERE freq.fold <> o.fold GROUP BY ALL)"""
    return f"{f}, {train}, {tables('train', ['repeat', 'fold', 'combo_id'], ['n_items', 'items'], method=method)}"


def nested(rows: str, items: Sequence[str], low: int, high: int, outer_k: int, inner_k: int, repeats: int, top: int, seed: int, inner_folds: str = "own") -> str:
    """CTEs up to ``inner_means`` and ``picked``: choice by mean inner AUC."""
    masks = " + ".join(f"CAST({x} AS DOUBLE) * m{i}" for i, x in enumerate(items))
    means = ", ".join(f"({' + '.join(f'max(CASE WHEN inner_fold = {i} THEN {c} END)' for i in range(1, inner_k + 1))}) / {inner_k} AS mean_{n}" for n, c in (("auc", "coalesce(auc, 0.5)"), ("sensitivity", "sensitivity"), ("specificity", "specificity"), ("youden", "youden")))
    ids = "repeat, outer_fold, position, combo_id, n_items"
    own = " + k.position" if inner_folds == "own" else ""
    return f"""{train_search(rows, items, low, high, outer_k, repeats, seed)},
kept AS (SELECT * FROM (SELECT repeat, fold, combo_id, n_items, items, cutoff, CAST(row_number() OVER (PARTITION BY repeat, fold ORDER BY auc DESC, youden DESC, sensitivity DESC, specificity DESC, n_items, combo_id) AS INTEGER) AS position FROM best) WHERE position <= {top}),
inner_rows AS (SELECT s.row_id, s.y, s.repeat, k.fold AS outer_fold, k.position, k.combo_id, k.n_items, {masks} AS score,
    ntile({inner_k}) OVER (PARTITION BY s.repeat, k.fold, k.position, s.y ORDER BY md5(CAST({seed} + (s.repeat - 1) * {outer_k} + k.fold{own} AS VARCHAR) || '|' || CAST(s.row_id AS VARCHAR)), s.row_id) AS inner_fold
  FROM src s JOIN kept k ON s.repeat = k.repeat AND s.fold <> k.fold JOIN cand c ON c.combo_id = k.combo_id),
inner_cells AS (SELECT {ids}, inner_fold, score, CAST(sum(y) AS BIGINT) AS p, CAST(sum(1 - y) AS BIGINT) AS n FROM inner_rows GROUP BY ALL),
inner_train AS (SELECT {', '.join('c.' + x for x in ids.split(', '))}, o.inner_fold, score, CAST(sum(p) AS BIGINT) AS p, CAST(sum(n) AS BIGINT) AS n
  FROM inner_cells c CROSS JOIN (SELECT f AS inner_fold FROM range(1, {inner_k + 1}) t(f)) o WHERE c.inner_fold <> o.inner_fold GROUP BY ALL),
{tables('inner_train', [*ids.split(', '), 'inner_fold'], prefix='i_')},
inner_hit AS (SELECT c.*, b.cutoff FROM inner_cells c JOIN i_best b USING ({ids}, inner_fold)),
{_tested('inner_hit', [*ids.split(', '), 'inner_fold'], 'inner_test')},
inner_means AS (SELECT {ids}, {means} FROM inner_test GROUP BY ALL),
picked AS (SELECT * FROM (SELECT m.*, k.items, k.cutoff, row_number() OVER (PARTITION BY m.repeat, outer_fold ORDER BY mean_auc DESC, m.position) AS pick FROM inner_means m JOIN kept k ON k.repeat = m.repeat AND k.fold = m.outer_fold AND k.position = m.position) WHERE pick = 1),
outer_hit AS (SELECT f.*, k.cutoff FROM freq f JOIN picked k ON f.repeat = k.repeat AND f.fold = k.outer_fold AND f.combo_id = k.combo_id),
{_tested('outer_hit', ['repeat', 'fold', 'combo_id', 'n_items', 'items'], 'outer_test')}"""


def _tested(cells: str, keys: Sequence[str], name: str) -> str:
    k = ", ".join(keys)
    return f"""{name}_below AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY {k} ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb FROM {cells}),
{name} AS (SELECT *, {metrics()}, CASE WHEN wp > 0 AND wn > 0 THEN wins / (2.0::DOUBLE * wp * wn) END AS auc FROM (SELECT {k}, cutoff,
    CAST(sum(CASE WHEN score >= cutoff THEN p ELSE 0 END) AS BIGINT) AS tp, CAST(sum(CASE WHEN score >= cutoff THEN n ELSE 0 END) AS BIGINT) AS fp,
    CAST(sum(CASE WHEN score < cutoff THEN p ELSE 0 END) AS BIGINT) AS fn, CAST(sum(CASE WHEN score < cutoff THEN n ELSE 0 END) AS BIGINT) AS tn,
    CAST(sum(p * (2 * nb + n)) AS DOUBLE) AS wins, CAST(sum(p) AS DOUBLE) AS wp, CAST(sum(n) AS DOUBLE) AS wn FROM {name}_below GROUP BY ALL))"""
