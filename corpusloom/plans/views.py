"""The test tables seen as the entities, documents and facts that the operators work on.

Each view is given once as a list of select expressions that Spark and DuckDB both
understand; only date arithmetic is written differently.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: view: (from, expressions)
_VIEWS = {
    "plan": (
        "customer",
        """c_custkey as id, c_name as name,
        case when c_custkey % 5 = 0 then null else concat('C', cast(c_custkey as varchar(20))) end as abbreviation,
        case when c_custkey % 11 = 0 then null else c_nationkey end as region_id,
        case when c_custkey % 13 = 0 then null else c_acctbal end as size,
        c_mktsegment as segment""",
    ),
    "doc": (
        "orders",
        """o_orderkey as id, o_custkey as plan_id,
        concat('https://h/', cast(o_orderkey % 9000 as varchar(20)), '.pdf') as url,
        case when o_orderkey % 17 = 0 then null when o_orderpriority = '1-URGENT' then 'agenda'
             when o_orderpriority = '2-HIGH' then 'minutes' when o_orderpriority = '3-MEDIUM' then 'board_pack'
             when o_orderpriority = '4-NOT SPECIFIED' then 'performance' else 'cafr' end as doc_type,
        case when o_orderstatus = 'F' then 'done' when o_orderstatus = 'O' then 'pending' else 'failed' end as status,
        case when o_orderkey % 7 = 0 then null else cast(o_orderdate as date) end as meeting_date,
        add_days(cast(o_orderdate as date), cast(o_orderkey % 90 - 30 as int)) as downloaded_on,
        case when o_orderkey % 19 = 0 then null else cast(extract(year from o_orderdate) as int) end as fiscal_year,
        o_totalprice as amount""",
    ),
    "summ": ("orders where o_orderkey % 3 <> 0", "o_orderkey * 10 as id, o_orderkey as document_id, o_orderkey % 1000 as text_id"),
    "act": (
        "lineitem join part on l_partkey = p_partkey",
        """l_orderkey as doc_id, l_linenumber as ord,
        case when l_suppkey % 23 = 0 then null when l_suppkey % 29 = 0 then 'N/A' else concat('S', cast(l_suppkey as varchar(20))) end as manager,
        case when l_returnflag = 'A' then 'hire' when l_returnflag = 'R' then 'fire' when l_linestatus = 'O' then 'commitment'
             when l_linenumber % 2 = 0 then 'other' else null end as action,
        p_type as asset_class,
        case when l_linenumber % 5 = 0 then null else cast(round(l_extendedprice * 100) as bigint) end as amount_cents""",
    ),
    "alloc": (
        "lineitem join part on l_partkey = p_partkey",
        """l_orderkey as extract_id, l_linenumber as seq, p_type as asset_class,
        case when l_linenumber % 4 = 0 then null else cast(round(l_tax * 10000) as int) end as target_bp,
        case when l_linenumber % 5 = 0 then null else cast(round(l_discount * 10000) as int) end as actual_bp,
        p_size as range_low, p_size + 10 as range_high""",
    ),
    "ev": ("events", "event_id as id, user_id as entity_id, event_type as status, ts, value, props"),
    "txt": ("documents", "doc_id as id, text, lang, source, n_chars"),
    "pg": ("pages", "page_id as id, url, html"),
    "lab": ("labels", "doc_id, quality, toxic"),
    "bench": ("benchmark", "item_id, text"),
}


class Views:
    """The views over one folder of tables, opened when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in _VIEWS:
            raise AttributeError(name)
        source, expressions = _VIEWS[name]
        source, _, where = source.partition(" where ")
        tables = source.split(" ")
        rows = self.table(tables[0])
        if len(tables) > 1:
            rows = rows.join(self.table("part"), F.col("l_partkey") == F.col("p_partkey"))
        if where:
            rows = rows.filter(where)
        text = expressions.replace("add_days(", "date_add(").replace("varchar(20)", "string")
        out = rows.selectExpr(*_split(text))
        self.__dict__[name] = out
        return out


def _split(text: str) -> list[str]:
    """Expressions of a select list, split at commas outside parentheses and quotes."""
    out, depth, quoted, at = [], 0, False, 0
    for i, c in enumerate(text):
        quoted ^= c == "'"
        depth += (c == "(") - (c == ")") if not quoted else 0
        if c == "," and not depth and not quoted:
            out.append(text[at:i])
            at = i + 1
    return [x.strip() for x in [*out, text[at:]]]


def with_views(sql: str) -> str:
    """DuckDB SQL with the views that it names as common table expressions before its own."""
    named = [v for v in _VIEWS if re.search(rf"\b{v}\b", sql)]
    parts = []
    for v in named:
        source, expressions = _VIEWS[v]
        text = re.sub(r"add_days\((cast\(o_orderdate as date\)), (cast\(.*? as int\))\)", r"(\1 + \2)", expressions)
        parts.append(f"{v} as (select {text} from {source})")
    body = sql.strip()
    if body.startswith("with "):
        parts.append(body[5:])
        return "with " + ",\n".join(parts)
    return ("with " + ",\n".join(parts) + "\n" if parts else "") + body
