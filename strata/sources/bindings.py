"""The given tables as graphs, sources and feeds.

Business rows become nodes and edges; pages and documents are source files; rows of other tables
are rendered, one file per row, as source text of each language. A rendered corpus grows with
its table, and what must be found in it follows from the table's columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from strata.functions.ids import edge_id
from strata.functions.props import to_map
from strata.operators.dedup import union_facts
from strata.sources.corpus import as_sources
from strata.sources.files import write_files


def load(spark: SparkSession, sf: str, table: str, spread_from: int | None = None) -> DataFrame:
    """A given table. A file of ``spread_from`` bytes or more that Spark cannot split (one row
    group) is spread over the cores; projections and filters still reach its scan."""
    df = spark.read.parquet(f"{sf}/{table}.parquet")
    cores = spark.sparkContext.defaultParallelism
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    # Larger inputs come in as many splits as they need.
    least = _UNSPLIT_FROM if spread_from is None else spread_from
    return df.repartition(cores) if least <= size < cores * _SPLIT else df


# Bytes from which one task is too few, and bytes of one split by Spark's default.
_UNSPLIT_FROM, _SPLIT = 1 << 20, 128 << 20


def key_id(kind: str, key: str) -> Column:
    """Entity id of a numeric key: digits need no folding, so the id is put together directly."""
    return F.concat(F.lit(f"{kind.lower()}:"), F.col(key).cast("string"))


# Node kinds with their key, name and owner columns.
_KINDS = {
    "region": ("r_regionkey", "r_name", None),
    "nation": ("n_nationkey", "n_name", ("region", "n_regionkey")),
    "customer": ("c_custkey", "c_name", ("nation", "c_nationkey")),
    "supplier": ("s_suppkey", "s_name", ("nation", "s_nationkey")),
    "part": ("p_partkey", "p_name", None),
    "orders": ("o_orderkey", "o_orderpriority", ("customer", "o_custkey")),
}


def rel_nodes(spark: SparkSession, sf: str, kinds=tuple(_KINDS)) -> DataFrame:
    """(entity_id, kind, name, parent_id, properties) of business rows."""
    out = []
    for kind in kinds:
        key, name, owner = _KINDS[kind]
        t = load(spark, sf, kind)
        parent = key_id(*owner) if owner else F.lit(None).cast("string")
        bag = {
            "customer": to_map(segment="c_mktsegment"), "part": to_map(brand="p_brand", type="p_type"),
            "orders": to_map(status="o_orderstatus"),
        }.get(kind, F.create_map().cast("map<string,string>"))
        out.append(t.select(key_id(kind, key).alias("entity_id"), F.lit(kind).alias("kind"),
                            F.col(name).alias("name"), parent.alias("parent_id"), bag.alias("properties")))
    return union_facts(*out)


def _pair(df: DataFrame, type_: str, source: Column, target: Column) -> DataFrame:
    return df.select(edge_id(type_, source, target).alias("entity_id"), F.lit(type_).alias("type"),
                     source.alias("source_id"), target.alias("target_id"))


def rel_edges(spark: SparkSession, sf: str, types=("CONTAINS", "PLACED", "CALLS", "USES")) -> DataFrame:
    """(entity_id, type, source_id, target_id); CALLS and USES repeat, one per lineitem row."""
    out = []
    if "CONTAINS" in types:
        for child in ("nation", "customer", "supplier"):
            key, _, owner = _KINDS[child]
            out.append(_pair(load(spark, sf, child), "CONTAINS", key_id(*owner), key_id(child, key)))
    if "PLACED" in types:
        out.append(_pair(load(spark, sf, "orders"), "PLACED", key_id("customer", "o_custkey"), key_id("orders", "o_orderkey")))
    if "CALLS" in types:
        out.append(_pair(load(spark, sf, "lineitem"), "CALLS", key_id("orders", "l_orderkey"), key_id("supplier", "l_suppkey")))
    if "USES" in types:
        out.append(_pair(load(spark, sf, "lineitem"), "USES", key_id("orders", "l_orderkey"), key_id("part", "l_partkey")))
    return union_facts(*out)


# Every column of lineitem, so that equal keys still have one order.
LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
              "l_returnflag", "l_linestatus", "l_shipdate"]


def order_calls(spark: SparkSession, sf: str) -> DataFrame:
    """One call site per lineitem row: order calls supplier."""
    return call_sites(load(spark, sf, "lineitem").withColumns(call_ids()))


def call_ids() -> dict[str, Column]:
    """Ids of a lineitem row's call and of its ends."""
    source, target = key_id("orders", "l_orderkey"), key_id("supplier", "l_suppkey")
    return {"source_id": source, "target_id": target, "entity_id": edge_id("CALLS", source, target)}


def call_sites(li: DataFrame) -> DataFrame:
    """Lineitem rows with the place and flags of their calls."""
    return li.select("*", F.col("l_linenumber").alias("call_line"), (F.col("l_linestatus") == "O").alias("is_awaited"),
                     (F.col("l_returnflag") == "R").alias("is_conditional"))


def page_path() -> Column:
    """Path part of a page's URL."""
    return F.regexp_extract("url", r"^[a-z]+://[^/?#]*([^?#]*)", 1)


def page_src(spark: SparkSession, sf: str) -> DataFrame:
    """Pages as sources: path is ``/pages/<id>`` and the URL path, so each page has its own."""
    p = load(spark, sf, "pages")
    return p.select(F.concat(F.lit("/pages/"), F.col("page_id").cast("string"), page_path()).alias("path"),
                    F.lit("HTML").alias("language"), F.col("html").alias("text"), "page_id", "url")


def page_scripts(spark: SparkSession, sf: str) -> DataFrame:
    """Bodies of page scripts as TypeScript sources; a page's scripts form one text."""
    p = page_src(spark, sf)
    bodies = F.regexp_extract_all("text", F.lit(r"(?s)<script>(.*?)</script>"), F.lit(1))
    return p.select("page_id", "path", F.lit("TypeScript").alias("language"), F.array_join(bodies, "\n").alias("text"))


def doc_src(spark: SparkSession, sf: str) -> DataFrame:
    d = load(spark, sf, "documents")
    path = F.concat_ws("/", F.lit(""), "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return d.select("doc_id", path.alias("path"), F.lit("Text").alias("language"), "text", "lang", "source")


def doc_files(spark: SparkSession, sf: str, root: str, *folders: str) -> None:
    """One text file per document below ``root``, ended by a line break, in a folder ``column=value`` for each of ``folders``.
    Files are numbered by partition and place in it, as no column need be unique."""
    d = load(spark, sf, "documents").select(*folders, "text")
    levels = [F.concat(F.lit(f"{c}="), F.url_encode(F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("__HIVE_DEFAULT_PARTITION__")))) for c in folders]
    path = F.concat_ws("/", *levels, F.concat(F.monotonically_increasing_id().cast("string"), F.lit(".txt")))
    files = d.select(path.alias("path"), F.concat(F.coalesce("text", F.lit("")), F.lit("\n")).alias("text"))
    write_files(files, root).write.format("noop").mode("overwrite").save()


def change_feed(spark: SparkSession, sf: str) -> DataFrame:
    """Events as changes of entities: the user is the entity, the time its version."""
    e = load(spark, sf, "events")
    return e.select("event_id", "ts", F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("entity_id"),
                    F.col("user_id"), F.col("event_type").alias("operation"), "value", "props")


def fill(template: str, **columns) -> Column:
    """Text of a template with ``{name}`` filled from columns; ``{{`` and ``}}`` stand for braces."""
    out, rest = [], template.replace("{{", "\x01").replace("}}}", "}\x02").replace("}}", "\x02")
    plain = lambda t: F.lit(t.replace("\x01", "{").replace("\x02", "}"))
    while "{" in rest:
        before, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        value = columns[name]
        out += [plain(before), (F.col(value) if isinstance(value, str) else value).cast("string")]
    return F.concat(*out, plain(rest))


_TS_SUPPLIER = """import {{ Nation{n}, area{n} as area }} from '../nation/n{n}';
import home, * as world from '../nation/n{n}.js';
import type {{ Rated }} from '../shared/rated';
export let rate{k}: number = {bal}, spare = 1;
/**
 * Ships goods.
 * @param qty amount
 * @returns nothing
 */
export async function ship{k}(qty: number, note?: string, ...rest: string[]): Promise<void> {{
  // if (never) {{ area(0); }}
  const text = "if (x) {{ fake(1); }} else";
  if (qty > {n} && note) {{ area(qty); }}
  await load{k}(qty);
  rate{k} = qty;
  world.area{n}(qty);
  home(text);
  rest.forEach((r, i) => {{ track(i); }});
  try {{ risky(qty); }} catch (e) {{ log(e); }}
}}
function load{k}(qty) {{
  for (let i = 0; i < {n}; i++) {{ track(i); }}
  return qty ? area(qty) : lone{k}();
}}
export class Supplier{k} extends Nation{n} implements Rated {{
  private static async open{k}(a: string, b = {n}): Promise<void> {{ this.close{k}(a); }}
  protected close{k}(a: string) {{ this.state = a; load{k}(1); }}
}}
export {{ load{k} as loader }};
"""
_TS_NATION = """export abstract class Nation{k} {{
  abstract label(): string;
}}
export function area{k}(x: number): number {{ return x || {r} || 0; }}
export interface Place{k} extends Base{r} {{
  size(unit: string): number;
}}
export type Code{k} = string;
export * from '../region';
export default area{k};
"""
_TS_REGION = """export interface Region{k} {{ size(): number; }}
"""
# Forms whose reading depends on what stands before them: declarators, regular expressions, templates.
_TS_NOTE = """import {{ area{n} as area }} from '../nation/n{n}';
const quote{k} = /['"`({{]/g, half{k} = {n} / 2 / 1, names{k}: Map<string, number> = new Map<string, number>(),
  pick{k} = (a, b) => {{ keen{k}(a, b); }}, last{k}: [string, number] = ["x, y", {n}];
export let open{k}: (a: number, b: string) => void, shut{k};
var one{k} = `const no = 1, not = 2`, two{k} = {{ a: 1, b: 2 }}
function text{k}(qty: number) {{
  const line = `to ${{area(qty)}} of ${{qty > 1 ? `x ${{pick{k}(qty, 1)}} }}{{` : "z"}}`, spare = 1;
  if (/[)'"]/.test(line)) {{ open{k} = qty / half{k} / 2; }}
  shut{k} = `${{`${{line}}`}}`;
  return line.split(/[,;'"]/).map(trim{k}) || note{k}(line / 2 / qty);
}}
for (let i = 0, j = 1; i < j; i++) {{ text{k}(`${{i}}`); }}
"""
_TSX_CUSTOMER = """import {{ {seg} }} from './seg/{lower}';
export const Customer{k} = (props: Props): JSX.Element => {{
  return (
    <div className="p-{n} flex  m-1" id='c{k}'>
      {{/* <span>no</span> */}}
      <{seg} key={{{k}}} title="{name}" bold />
    </div>
  );
}};
"""
_TSX_SEGMENT = """export function {seg}(props) {{
  return <b className="flex">{seg}</b>;
}}
"""
_JAVA_PART = """package shop.{type};

import java.util.List;
import shop.brand.*;

/** Part. {{ */
public class Part{k} extends Base implements Item, Sized {{
    private final List<String> names = null;
    int size = {size}, weight;
    public Part{k}(int size) {{ this.size = size; }}
    public int getSize{k}(List<Integer> xs) throws Exception {{
        String s = "class Fake {{";
        return size;
    }}
    enum Grade {{ LOW, HIGH }}
}}
interface Item{k} {{
    void use{k}(int times);
}}
"""
_GO_ORDER = """package p{status}

import (
\t"fmt"
\th "net/http"
)

type Order{k} struct {{
\ttotal int
}}

type Key{k} string

func New{k}(total int) *Order{k} {{
\treturn &Order{k}{{total: total}}
}}

func (o *Order{k}) Total{c}() int {{
\tif o.total > {c} {{ fmt.Println("func fake() {{") }}
\treturn o.total
}}
"""
_CS_CUSTOMER = """using System;
using static System.Math;
using Text = System.Text;

namespace Shop.{seg}
{{
    public class Customer{k} : Base
    {{
        private int nation = {n}, region;
        public string Name {{ get; set; }}
        public Customer{k}(int n) {{ nation = n; }}
        public int Nation{k}(int a, string b = "{{")
        {{
            return a + nation;
        }}
    }}
    interface IKnown{k} {{ bool Known(int a); }}
    struct Point{k} {{ public int X; }}
}}
"""
_CPP_PART = """#include "{brand}.h"
#include <vector>
#define SIZE{k} {size}

class Part{k} : public Base, private Item<int> {{
public:
    virtual double price() const = 0;
    Part{k}(int s) : size(s) {{}}
    int twice() const {{ return 2 * size; }}
private:
    int size;
}};

static int make{k}(int n) {{
    if (n > SIZE{k}) {{ return helper("{{", n); }}
    return n;
}}
"""
_CPP_BRAND = """#define {brand}
int {brand}_id(void) {{ return 1; }}
"""
_PY_CUSTOMER = """import os, sys as system
from shop.{seg} import nation{n} as home
LIMIT{k} = {n}

class Customer{k}(Base):
    kind = "def fake():"

    def __init__(self, name):
        self.name = name
        label = helper{k}(name)

    async def visit(self, place):
        return home(place)


def helper{k}(x, y=0):
    total = x
    return print(total)


helper{k}(LIMIT{k})
"""
_SQL_PART = """-- create table fake (x int);
CREATE TABLE shop.part{k} (
  id INT PRIMARY KEY,
  price DECIMAL(10, {size}) DEFAULT 0,
  label VARCHAR(20) DEFAULT 'a;b',
  CONSTRAINT pk{k} UNIQUE (id, label)
);
CREATE VIEW shop.view{k} AS SELECT id FROM shop.part{k} WHERE price > {size};
INSERT INTO shop.part{k} VALUES (1, {size}, 'from nowhere');
SELECT * FROM shop.view{k} JOIN missing{size} ON 1 = 1;
UPDATE shop.part{k} SET price = 0;
DELETE FROM shop.part{k};
"""


_SQL_ROUTINES = """CREATE TABLE shop.stock{k} (id INT, n INT);
CREATE OR REPLACE FUNCTION shop.price{k}(p INT, q DECIMAL(10, 2)) RETURNS INT AS $body$
DECLARE total INT; -- from nowhere;
BEGIN
  SELECT sum(n) INTO total FROM shop.stock{k} WHERE label <> 'a;b from fake';
  IF total > {size} THEN RETURN CASE WHEN total > 1 THEN shop.base{half}(1) END; END IF;
  RETURN total;
END;
$body$ LANGUAGE plpgsql;
CREATE PROCEDURE shop.fill{k}(IN x INT)
BEGIN
  DECLARE i INT;
  WHILE i < x DO SET i = i + 1; END WHILE;
  BEGIN INSERT INTO shop.stock{k} VALUES (x, shop.price{k}(x, 1)); END;
  CALL shop.log{k}(x);
END;
CREATE PROCEDURE shop.log{k}(x INT) AS BEGIN DELETE FROM shop.stock{k}; EXEC shop.fill{k} 1; END;
SELECT shop.price{k}(1, 2), lower('x') FROM shop.stock{k};
CALL shop.fill{k}(3);
"""


def _render(df: DataFrame, path: Column, text: Column) -> DataFrame:
    """One source per row."""
    return as_sources(df.select(path.alias("path"), text.alias("text")))


def ts_src(spark: SparkSession, sf: str) -> DataFrame:
    """A TypeScript file per supplier, nation and region, importing one another."""
    s, n, r = (load(spark, sf, t, 0) for t in ("supplier", "nation", "region"))
    return union_facts(
        _render(s, fill("/shop/supplier/s{k}.ts", k="s_suppkey"),
                fill(_TS_SUPPLIER, k="s_suppkey", n="s_nationkey", bal=F.floor("s_acctbal"))),
        _render(n, fill("/shop/nation/n{k}.ts", k="n_nationkey"), fill(_TS_NATION, k="n_nationkey", r="n_regionkey")),
        _render(r.where("r_regionkey > 0"), fill("/shop/region/r{k}.ts", k="r_regionkey"), fill(_TS_REGION, k="r_regionkey")),
        _render(r.where("r_regionkey = 0"), F.lit("/shop/region/index.ts"), fill(_TS_REGION, k="r_regionkey")))


def note_src(spark: SparkSession, sf: str) -> DataFrame:
    """A TypeScript file per customer in which quotes, slashes, commas and braces mean several things, and the nations."""
    c, n = load(spark, sf, "customer", 0), load(spark, sf, "nation", 0)
    return union_facts(
        _render(c, fill("/shop/note/c{k}.ts", k="c_custkey"), fill(_TS_NOTE, k="c_custkey", n="c_nationkey")),
        _render(n, fill("/shop/nation/n{k}.ts", k="n_nationkey"), fill(_TS_NATION, k="n_nationkey", r="n_regionkey")))


def tsx_src(spark: SparkSession, sf: str) -> DataFrame:
    """A component file per customer, using the component of its market segment."""
    c = load(spark, sf, "customer", 0).withColumn("seg", F.initcap("c_mktsegment"))
    segs = c.select("seg").distinct()
    return union_facts(
        _render(c, fill("/ui/c{k}.tsx", k="c_custkey"), fill(
            _TSX_CUSTOMER, seg="seg", lower=F.lower("seg"), k="c_custkey", n="c_nationkey", name="c_name")),
        _render(segs, fill("/ui/seg/{s}.tsx", s=F.lower("seg")), fill(_TSX_SEGMENT, seg="seg")))


def java_src(spark: SparkSession, sf: str) -> DataFrame:
    return _render(load(spark, sf, "part", 0), fill("/java/Part{k}.java", k="p_partkey"),
                   fill(_JAVA_PART, type=F.lower("p_type"), k="p_partkey", size="p_size"))


def go_src(spark: SparkSession, sf: str) -> DataFrame:
    return _render(load(spark, sf, "orders", 0), fill("/go/o{k}.go", k="o_orderkey"),
                   fill(_GO_ORDER, status=F.lower("o_orderstatus"), k="o_orderkey", c="o_custkey"))


def cs_src(spark: SparkSession, sf: str) -> DataFrame:
    return _render(load(spark, sf, "customer", 0), fill("/cs/c{k}.cs", k="c_custkey"), fill(
        _CS_CUSTOMER, seg=F.initcap("c_mktsegment"), k="c_custkey", n="c_nationkey"))


def cpp_src(spark: SparkSession, sf: str) -> DataFrame:
    """A C++ file per part and a C header per brand; some brands have no header."""
    p = load(spark, sf, "part", 0).withColumn("brand", F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))))
    heads = p.select("brand").where("not brand like '%1'").distinct()
    return union_facts(
        _render(p, fill("/cpp/p{k}.cpp", k="p_partkey"), fill(_CPP_PART, brand="brand", k="p_partkey", size="p_size")),
        _render(heads, fill("/cpp/{b}.h", b="brand"), fill(_CPP_BRAND, brand="brand")))


def py_src(spark: SparkSession, sf: str) -> DataFrame:
    return _render(load(spark, sf, "customer", 0), fill("/py/c{k}.py", k="c_custkey"), fill(
        _PY_CUSTOMER, seg=F.lower("c_mktsegment"), k="c_custkey", n="c_nationkey"))


def sql_src(spark: SparkSession, sf: str) -> DataFrame:
    return _render(load(spark, sf, "part", 0), fill("/sql/p{k}.sql", k="p_partkey"), fill(_SQL_PART, k="p_partkey", size="p_size"))


def routine_src(spark: SparkSession, sf: str) -> DataFrame:
    """A file with routines per part, and one per size with the function that they share."""
    p = load(spark, sf, "part", 0)
    sizes = p.select("p_size").distinct()
    return union_facts(
        _render(p, fill("/sql/r{k}.sql", k="p_partkey"), fill(_SQL_ROUTINES, k="p_partkey", size="p_size", half="p_size")),
        _render(sizes, fill("/sql/base{k}.sql", k="p_size"), fill("CREATE FUNCTION shop.base{k}(a INT) RETURNS INT RETURN a + {k};\n", k="p_size")))
