"""SQL text of the derived datasets, for the SQL side of each query."""

from __future__ import annotations

_LINE_KEY = (
    "concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber, cast(l_quantity AS INTEGER))"
)

CTE = {
    "line_reg": f"""SELECT {_LINE_KEY} AS row_id, l_extendedprice, l_quantity, l_discount,
        CASE WHEN l_orderkey % 7 <> 0 THEN l_tax END AS l_tax_n, l_returnflag, l_linestatus,
        l_extendedprice * (1 - l_discount) * (1 + l_tax) AS __target__ FROM lineitem""",
    "line_cls": f"""SELECT {_LINE_KEY} AS row_id, l_discount, l_quantity,
        CASE WHEN l_orderkey % 7 <> 0 THEN l_tax END AS l_tax_n, l_extendedprice, l_returnflag,
        l_linestatus, CASE WHEN l_discount * 10 + l_quantity / 50
          + (CASE WHEN l_returnflag = 'R' THEN 0.5e0 ELSE 0e0 END) > 1.15e0
          THEN '1' ELSE '0' END AS __target__ FROM lineitem""",
    "order_cls3": """SELECT cast(o_orderkey AS VARCHAR) AS row_id, o_totalprice, o_orderpriority,
        cast(month(o_orderdate) AS INTEGER) AS o_month, o_orderstatus AS __target__ FROM orders""",
    "event_skew": """SELECT cast(event_id AS VARCHAR) AS row_id, value,
        value * value * value AS value3, props, event_type AS __target__ FROM events""",
    "event_std": """SELECT cast(event_id AS VARCHAR) AS row_id, value,
        event_type AS __target__ FROM events""",
    "doc_quality": """SELECT cast(d.doc_id AS VARCHAR) AS row_id, n_chars, lang, source,
        cast(quality AS VARCHAR) AS __target__ FROM documents d JOIN labels l USING (doc_id)""",
    "part_reg": """SELECT cast(p_partkey AS VARCHAR) AS row_id, p_brand, p_type, p_size,
        p_retailprice AS __target__ FROM part""",
    "embed_cls10": "SELECT cast(vec_id AS VARCHAR) AS row_id, "
    + ", ".join(f"cast(embedding[{i + 1}] AS DOUBLE) AS e{i}" for i in range(64))
    + ", cast(label AS VARCHAR) AS __target__ FROM embeddings",
    "preds": f"""SELECT row_id, l_returnflag AS run, cast(l_quantity AS INTEGER) % 5 AS fold,
        cast(__target__ AS INTEGER) AS y, p1, CASE WHEN p1 > 0.5e0 THEN 1 ELSE 0 END AS pred,
        1 - p1 AS p0 FROM (SELECT *, round(1e0 / (1e0 + exp(-8e0 * (l_discount * 10
        + l_quantity / 50 - 1))), 6) AS p1 FROM line_cls)""",
    "runs": """SELECT dataset || '__' || model || '__' || mode || '__' || seed AS run_id, dataset,
        model, mode, seed, tier, task,
        CASE WHEN task = 'classification' THEN score END AS roc_auc_mean,
        CASE WHEN task = 'regression' THEN -score END AS neg_rmse_mean,
        CASE WHEN task = 'classification' THEN err END AS ece_mean,
        CASE WHEN task = 'classification' THEN err * 2 END AS brier_mean,
        CASE WHEN task = 'regression' AND model = 'hist_gb' THEN err * 10 END AS picp_80_mean,
        CASE WHEN task = 'regression' AND model = 'hist_gb' THEN secs / 10 END AS mpiw_80_norm_mean,
        CASE WHEN mode = 'automated' THEN secs END AS hpo_seconds_total,
        secs / 100 AS fit_seconds_mean, n_rows / 1000e0 AS model_size_mb_mean,
        secs * 2 AS latency_ms_per_1k_mean,
        CASE WHEN task = 'classification' THEN score ELSE -score END AS "primary"
      FROM (SELECT dataset, model, mode, seed, task, tier, floor(cast(sum(d) AS DOUBLE) * 1048576 / (count(*) * 10)) / 1048576e0 AS score,
          floor(cast(sum(t) AS DOUBLE) * 1048576 / (count(*) * 100)) / 1048576e0 AS err,
          floor(cast(sum(q) AS DOUBLE) * 1048576 / count(*)) / 1048576e0 AS secs,
          count(*) AS n_rows
        FROM (SELECT 'ds_' || l_returnflag || l_linestatus AS dataset,
            ['linear', 'hist_gb', 'xgboost'][l_partkey % 3 + 1] AS model,
            ['automated', 'baseline_default', 'baseline_expert'][l_suppkey % 3 + 1] AS mode,
            cast(l_orderkey % 3 + 42 AS INTEGER) AS seed,
            CASE WHEN l_returnflag = 'R' THEN 'regression' ELSE 'classification' END AS task,
            CASE WHEN l_linestatus = 'O' THEN 'small' ELSE 'medium' END AS tier,
            cast(round(l_discount * 100) AS BIGINT) AS d, cast(round(l_tax * 100) AS BIGINT) AS t,
            cast(l_quantity AS BIGINT) AS q FROM lineitem)
        GROUP BY ALL)""",
}
_NEEDS = {"preds": ["line_cls"]}


def with_cte(*names: str, extra: str = "") -> str:
    """A WITH clause for the named datasets, plus further CTE text."""
    ordered: list[str] = []
    for name in names:
        for needed in [*_NEEDS.get(name, []), name]:
            if needed not in ordered:
                ordered.append(needed)
    parts = [f"{name} AS ({CTE[name]})" for name in ordered]
    if extra:
        parts.append(extra)
    return "WITH " + ",\n".join(parts) + "\n"


def seeded(seed: int | str, key: str = "row_id") -> str:
    return f"md5('{seed}:' || {key})"
