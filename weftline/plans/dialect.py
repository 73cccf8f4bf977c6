"""The few expressions that Spark SQL and DuckDB write differently, so that a plan is stated once."""

from __future__ import annotations


class Spark:
    text, explode, real = "STRING", "explode", "DOUBLE"
    #: Tasks for steps that read little and compute much, which would be put together by their size.
    tasks = 64

    def __init__(self, session=None):
        if session is not None:
            self.tasks = max(int(session.conf.get("spark.sql.shuffle.partitions")), 4 * session.sparkContext.defaultParallelism)

    def scan(self, folder: str, table: str) -> str:
        return f"{table} AS (SELECT * FROM parquet.`{folder}/{table}.parquet`)"

    def pattern(self, p: str) -> str:
        return f'r"{p}"'

    def all_matches(self, x: str, p: str) -> str:
        return f"regexp_extract_all({x}, {self.pattern(p)}, 0)"

    def match(self, x: str, p: str, group: int = 0) -> str:
        return f"regexp_extract({x}, {self.pattern(p)}, {group})"

    def replace(self, x: str, p: str, to: str) -> str:
        return f"regexp_replace({x}, {self.pattern(p)}, {self.pattern(to)})"

    def like(self, x: str, p: str) -> str:
        return f"({x} RLIKE {self.pattern(p)})"

    def size(self, x: str) -> str:
        return f"size({x})"

    def octets(self, x: str) -> str:
        return f"octet_length({x})"

    def intdiv(self, a: str, b: str) -> str:
        return f"({a} DIV {b})"

    def trim_both(self, x: str, chars: str) -> str:
        return f"trim(BOTH {self.pattern(chars)} FROM {x})"

    def months_later(self, ts: str, n: str) -> str:
        return f"({ts} + make_interval(0, CAST({n} AS INT)))"

    def slice(self, x: str, a: str, b: str) -> str:
        return f"slice({x}, {a}, greatest({b} - {a} + 1, 0))"

    def join_words(self, x: str) -> str:
        return f"array_join({x}, ' ')"

    def numbers(self, a: str, b: str) -> str:
        return f"(CASE WHEN {b} >= {a} THEN sequence({a}, {b}) ELSE array() END)"

    def item(self, x: str, k: str) -> str:
        return f"try_element_at({x}, CAST({k} AS INT))"

    def split(self, x: str, p: str) -> str:
        return f"split({x}, {self.pattern(p)})"

    def day(self, ts: str) -> str:
        return f"date_format({ts}, 'yyyy-MM')"

    def json(self, x: str, key: str) -> str:
        return f"get_json_object({x}, '$.{key}')"

    def has(self, x: str, y: str) -> str:
        return f"contains({x}, {y})"

    def filter(self, x: str, item: str, test: str) -> str:
        return f"filter({x}, {item} -> {test})"

    def transform(self, x: str, item: str, to: str) -> str:
        return f"transform({x}, {item} -> {to})"

    def anti(self) -> str:
        return "LEFT ANTI JOIN"

    def greatest_of(self, x: str) -> str:
        return f"array_max({x})"

    def groups(self, x: str, p: str, group: int) -> str:
        return f"regexp_extract_all({x}, {self.pattern(p)}, {group})"

    def decimals(self, x: str, n: int) -> str:
        return f"format_string('%.{n}f', CAST({x} AS DOUBLE))"

    def rtrim(self, x: str, chars: str) -> str:
        return f"rtrim('{chars}', {x})"

    def join_list(self, x: str, order: str, by: str = ",") -> str:
        return f"array_join(transform(array_sort(collect_list(struct({order} AS o, {x} AS v))), y -> y.v), '{by}')"

    def try_double(self, x: str) -> str:
        return f"try_cast({x} AS DOUBLE)"

    def plain(self, x: str, a: str, b: str) -> str:
        return f"replace({x}, '{a}', '{b}')"


class Duck(Spark):
    text, explode = "VARCHAR", "unnest"

    def pattern(self, p: str) -> str:
        return "'" + p.replace("'", "''") + "'"

    def scan(self, folder: str, table: str) -> str:
        return ""

    def all_matches(self, x: str, p: str) -> str:
        return f"regexp_extract_all({x}, {self.pattern(p)})"

    def replace(self, x: str, p: str, to: str) -> str:
        return f"regexp_replace({x}, {self.pattern(p)}, {self.pattern(to)}, 'g')"

    def like(self, x: str, p: str) -> str:
        return f"regexp_matches({x}, {self.pattern(p)})"

    def size(self, x: str) -> str:
        return f"len({x})"

    def octets(self, x: str) -> str:
        return f"strlen({x})"

    def intdiv(self, a: str, b: str) -> str:
        return f"({a} // {b})"

    def trim_both(self, x: str, chars: str) -> str:
        return f"trim({x}, {self.pattern(chars)})"

    def months_later(self, ts: str, n: str) -> str:
        return f"({ts} + to_months(CAST({n} AS INT)))"

    def slice(self, x: str, a: str, b: str) -> str:
        return f"list_slice({x}, {a}, {b})"

    def join_words(self, x: str) -> str:
        return f"array_to_string({x}, ' ')"

    def numbers(self, a: str, b: str) -> str:
        return f"generate_series({a}, {b})"

    def item(self, x: str, k: str) -> str:
        return f"{x}[{k}]"

    def split(self, x: str, p: str) -> str:
        return f"regexp_split_to_array({x}, {self.pattern(p)})"

    def day(self, ts: str) -> str:
        return f"strftime({ts}, '%Y-%m')"

    def json(self, x: str, key: str) -> str:
        return f"json_extract_string({x}, '$.{key}')"

    def filter(self, x: str, item: str, test: str) -> str:
        return f"list_filter({x}, lambda {item}: {test})"

    def transform(self, x: str, item: str, to: str) -> str:
        return f"list_transform({x}, lambda {item}: {to})"

    def anti(self) -> str:
        return "ANTI JOIN"

    def greatest_of(self, x: str) -> str:
        return f"list_max({x})"

    def decimals(self, x: str, n: int) -> str:
        return f"printf('%.{n}f', CAST({x} AS DOUBLE))"

    def rtrim(self, x: str, chars: str) -> str:
        return f"rtrim({x}, '{chars}')"

    def join_list(self, x: str, order: str, by: str = ",") -> str:
        return f"string_agg({x}, '{by}' ORDER BY {order})"

    def try_double(self, x: str) -> str:
        return f"try_cast({x} AS DOUBLE)"
