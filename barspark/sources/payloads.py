"""Readers of market payloads: daily prices, flow and fundamentals in JSON and CSV, with text numbers and local dates."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barspark.functions.scalars import iso_date, real_number, whole_number

#: Orders in which encodings are tried.
FLOW_ENCODINGS, DAILY_ENCODINGS = ("cp950", "utf-8-sig", "utf-8"), ("utf-8-sig", "cp950", "utf-8")


def decoded(content: Column, encodings: tuple[str, ...] = DAILY_ENCODINGS) -> Column:
    """Text of bytes in the first encoding that fits, else with replaced characters. Python, as the JVM has no way to try."""
    def read(raw: bytes | None) -> str | None:
        if raw is None:
            return None
        for e in encodings:
            try:
                return raw.decode(e)
            except UnicodeDecodeError:
                continue
        return raw.decode(encodings[-1], "replace")

    @F.pandas_udf("string")
    def text(column: pd.Series) -> pd.Series:
        return column.map(read)

    return text(content)


def table_rows(payloads: DataFrame, column: str = "payload", path: str = "data") -> DataFrame:
    """The other columns of payloads and `row`, an array of texts, for each row of the JSON's table at path."""
    kept = [c for c in payloads.columns if c != column]
    rows = F.from_json(F.get_json_object(column, f"$.{path}"), "array<array<string>>")
    return payloads.select(*kept, F.explode(rows).alias("row"))


def largest_table(payload: Column, must_have: str) -> Column:
    """The rows of the largest table of `tables` that has a field containing must_have; null if none has."""
    tables = F.from_json(F.get_json_object(payload, "$.tables"), "array<struct<fields:array<string>,data:array<array<string>>>>")
    fit = F.filter(tables, lambda t: F.exists(F.coalesce(t["fields"], F.array().cast("array<string>")), lambda f: f.contains(must_have)))
    sized = F.transform(fit, lambda t: F.struct(F.size(t["data"]).alias("n"), t["data"].alias("data")))
    return F.when(F.size(fit) > 0, F.array_max(sized)["data"])


def stock_flow(payloads: DataFrame, foreign: tuple[int, ...], trust: tuple[int, ...], dealer: tuple[int, ...], drop_warrants: bool = True) -> DataFrame:
    """ts, code, name and nets of flow by investor; positions of a row that are summed. payloads has date and payload."""
    rows = table_rows(payloads.select(iso_date(F.col("date")).alias("ts"), "payload"))
    total = lambda at: sum((whole_number(F.get("row", i)) for i in at[1:]), whole_number(F.get("row", at[0])))
    out = rows.select("ts", F.trim(F.get("row", 0)).alias("code"), F.trim(F.get("row", 1)).alias("name"), total(foreign).alias("foreign_net"), total(trust).alias("trust_net"), total(dealer).alias("dealer_net"))
    if drop_warrants:
        out = out.where(~is_warrant(F.col("code")))
    return out.withColumn("inst_total", F.col("foreign_net") + F.col("trust_net") + F.col("dealer_net"))


def is_warrant(code: Column) -> Column:
    return F.length(code).isin(6) & code.rlike(r"^[01378]\d") & ~code.startswith("00")


def is_listed_share(code: Column) -> Column:
    return code.rlike(r"^[1-9]\d{3}$")


def layout_faults(rows: DataFrame, identities: dict[str, tuple[int, int, int]]) -> DataFrame:
    """Number of rows, and of those that break each identity row[a] + row[b] = row[c]."""
    cell = lambda i: whole_number(F.get("row", i))
    return rows.agg(F.count("*").alias("rows"), *(F.count_if(cell(a) + cell(b) != cell(c)).alias(n) for n, (a, b, c) in identities.items()))


def market_flow(payloads: DataFrame, labels: dict[str, tuple[str, ...]], value_at: int) -> DataFrame:
    """ts and the sum of the rows whose label contains one of the words of each investor; inst_total is their sum."""
    rows = table_rows(payloads.select(iso_date(F.col("date")).alias("ts"), "payload"))
    label = F.get("row", 0)
    net = whole_number(F.get("row", value_at))

    def of(words: tuple[str, ...]) -> Column:
        hit = F.lit(False)
        for w in words:
            hit = hit | label.contains(w)
        return F.coalesce(F.sum(F.when(hit, net)), F.lit(0).cast("long"))

    out = rows.groupBy("ts").agg(*(of(words).alias(name) for name, words in labels.items()))
    return out.withColumn("inst_total", sum((F.col(n) for n in list(labels)[1:]), F.col(list(labels)[0])))


def daily_prices(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    """ts, code, name, open, high, low, close, volume from a table with text columns; names maps ours to theirs.

    Rows without a close go; a volume that cannot be read counts 0.
    """
    price = lambda c: real_number(F.col(names[c])).alias(c)
    out = rows.select(iso_date(F.col(names["ts"])).alias("ts"), F.trim(names["code"]).alias("code"), F.trim(names["name"]).alias("name"), *(price(c) for c in ("open", "high", "low", "close")), F.coalesce(real_number(F.col(names["volume"])), F.lit(0.0)).alias("volume"))
    return out.where("close is not null")


def read_csv(spark: SparkSession, path: str, schema: str, encoding: str = "UTF-8") -> DataFrame:
    """A CSV with a header; malformed rows are skipped."""
    return spark.read.schema(schema).option("header", True).option("encoding", encoding).option("mode", "DROPMALFORMED").csv(path)


def income(rows: DataFrame) -> DataFrame:
    """code, eps, gross_margin_pct (2 places) of rows with code, revenue, gross and eps as texts."""
    gross, revenue = real_number(F.col("gross")), real_number(F.col("revenue"))
    return rows.select(F.trim("code").alias("code"), real_number(F.col("eps")).alias("eps"), F.when(revenue != 0, F.round(gross / revenue * 100, 2)).alias("gross_margin_pct"))


def equity(rows: DataFrame) -> DataFrame:
    """code, equity: the total, else that of the parent, else assets less debts."""
    n = lambda c: real_number(F.col(c))
    return rows.select(F.trim("code").alias("code"), F.coalesce(n("total_equity"), n("parent_equity"), n("assets") - n("debts")).alias("equity"))


def monthly_revenue(rows: DataFrame) -> DataFrame:
    n = lambda c: real_number(F.col(c)).alias(c)
    return rows.select(F.trim("code").alias("code"), n("month_revenue"), n("revenue_mom_pct"), n("revenue_yoy_pct"))


#: Labels of the rows of the margin table, columns of the futures flow file, and headers of the futures price file.
MARGIN_ROWS = {"margin": "融資(交易單位)", "short": "融券(交易單位)", "margin_amount": "融資金額"}
FUTURES_FLOW = {"net_trade": 7, "net_trade_amount": 8, "net_oi": 13, "net_oi_amount": 14}
FUTURES_HEADERS = {
    "ts": ("交易日期", "日期"),
    "product": ("契約", "商品代號"),
    "month": ("到期月份(週別)", "到期月份"),
    "open": ("開盤價",),
    "high": ("最高價",),
    "low": ("最低價",),
    "close": ("收盤價",),
    "volume": ("成交量",),
    "session": ("交易時段",),
}


def utc(text: Column) -> Column:
    """A timestamp without zone, in UTC, of an ISO 8601 text with or without an offset; null if it is none."""
    zoned = text.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    instant = F.try_to_timestamp(F.when(zoned, text).otherwise(F.concat(text, F.lit("Z"))))
    return F.to_timestamp_ntz(F.date_format(F.to_utc_timestamp(instant, F.current_timezone()), "yyyy-MM-dd HH:mm:ss.SSSSSS"))


def margin(payloads: DataFrame) -> DataFrame:
    """ts and margin_balance, margin_previous, short_balance, short_previous, margin_amount of a day's credit table.

    payloads has date and payload; one whose stat is not OK gives no row. Of each labelled row the fifth cell is the day
    before and the sixth the day itself; a label that is missing counts 0.
    """
    tables = F.from_json(F.get_json_object("payload", "$.tables"), "array<struct<data:array<array<string>>>>")
    rows = F.flatten(F.transform(tables, lambda t: F.coalesce(t["data"], F.array().cast("array<array<string>>"))))
    good = payloads.where(F.get_json_object("payload", "$.stat") == "OK").select(iso_date(F.col("date")).alias("ts"), rows.alias("rows"))

    def cell(label: str, at: int) -> Column:
        hit = F.filter("rows", lambda r: (F.size(r) >= 6) & F.get(r, 0).startswith(label))
        return F.coalesce(whole_number(F.get(F.element_at(F.when(F.size(hit) > 0, hit), -1), at)), F.lit(0).cast("long"))

    pairs = [(k, label) for k, label in MARGIN_ROWS.items() if k != "margin_amount"]
    both = [c for k, label in pairs for c in (cell(label, 5).alias(f"{k}_balance"), cell(label, 4).alias(f"{k}_previous"))]
    return good.select("ts", *both, cell(MARGIN_ROWS["margin_amount"], 5).alias("margin_amount"))


def cells(line: Column) -> Column:
    """The fields of a line of CSV; quotes around a field go, and separators within quotes stay."""
    parts = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(r',(\s*"(?:[^"]|"")*"\s*|[^,]*)'), F.lit(1))
    return F.transform(parts, lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r'^\s*"|"\s*$', ""), '""', '"')))


def lines(texts: DataFrame, column: str = "text") -> DataFrame:
    """The other columns, number and cells of each line that is not blank."""
    kept = [c for c in texts.columns if c != column]
    rows = texts.select(*kept, F.posexplode(F.split(column, r"\r?\n")).alias("number", "line"))
    return rows.where(F.trim("line") != "").select(*kept, "number", cells(F.col("line")).alias("cells"))


def futures_flow(texts: DataFrame, products: tuple[str, ...] | None = None) -> DataFrame:
    """ts, product, investor and the nets of trades and open interest; texts has a column text. The header and short lines go."""
    rows = lines(texts.select("text")).where((F.col("number") > 0) & (F.size("cells") > max(FUTURES_FLOW.values())))
    at = lambda k: F.get("cells", k)
    nets = [F.coalesce(whole_number(at(k)), F.lit(0).cast("long")).alias(n) for n, k in FUTURES_FLOW.items()]
    out = rows.select(iso_date(at(0)).alias("ts"), F.trim(at(1)).alias("product"), F.trim(at(2)).alias("investor"), *nets).where("investor <> ''")
    return out if products is None else out.where(F.col("product").isin(list(products)))


def unzipped(files: DataFrame) -> DataFrame:
    """path and text of files (path, content): the CSV members of a ZIP archive, or the file itself, decoded.

    Archives are opened in the executors, one file at a time.
    """
    def read(batches):
        for pdf in batches:
            out = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                if bytes(content[:2]) == b"PK":
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        out += [(f"{path}/{m}", z.read(m)) for m in z.namelist() if m.lower().endswith(".csv")]
                else:
                    out.append((path, bytes(content)))
            yield pd.DataFrame(out, columns=["path", "content"])

    members = files.select("path", "content").mapInPandas(read, "path string, content binary")
    return members.select("path", decoded(F.col("content"), FLOW_ENCODINGS).alias("text"))


def futures_prices(texts: DataFrame) -> DataFrame:
    """ts, product, month, session (regular or after), open, high, low, close, volume of texts (path, text) of futures price files.

    Columns are found by the names in each file's header, the first line that names day, product and month; lines before it and lines
    without a date go. A file without sessions is of the regular one; a price that cannot be read is null.
    """
    rows = lines(texts.select("path", "text"))
    place = lambda names: F.coalesce(*(F.nullif(F.array_position(F.transform("cells", lambda x: F.regexp_replace(x, " ", "")), n), F.lit(0)) for n in names))
    found = F.struct(*(place(names).alias(c) for c, names in FUTURES_HEADERS.items()))
    known = F.when(found["ts"].isNotNull() & found["product"].isNotNull() & found["month"].isNotNull(), found)
    upto = Window.partitionBy("path").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("at", F.first(known, ignorenulls=True).over(upto)).where("at is not null")
    cell = lambda c: F.trim(F.get("cells", F.col(f"at.{c}") - 1))
    session = F.when(cell("session") == "盤後", "after").otherwise("regular")
    prices = [real_number(cell(c)).alias(c) for c in ("open", "high", "low", "close", "volume")]
    return rows.select(iso_date(cell("ts")).alias("ts"), F.upper(cell("product")).alias("product"), F.regexp_replace(cell("month"), " ", "").alias("month"), session.alias("session"), *prices).where("ts is not null")


def listed_valuation(payloads: DataFrame) -> DataFrame:
    """code, name, close, yield_pct, pe, pb of listed shares; payloads has payload, a table of texts. Short rows go."""
    rows = table_rows(payloads.where(F.get_json_object("payload", "$.stat") == "OK").select("payload")).where(F.size("row") >= 7)
    n = lambda i: real_number(F.get("row", i))
    out = rows.select(F.trim(F.get("row", 0)).alias("code"), F.trim(F.get("row", 1)).alias("name"), n(2).alias("close"), n(3).alias("yield_pct"), n(5).alias("pe"), n(6).alias("pb"))
    return out.where(is_listed_share(F.col("code")))


def counter_valuation(rows: DataFrame) -> DataFrame:
    """The same of shares traded over the counter, from rows with text columns; their close is null, as the source has none."""
    n = lambda c: real_number(F.col(c))
    out = rows.select(
        F.trim("SecuritiesCompanyCode").alias("code"), F.trim("CompanyName").alias("name"), F.lit(None).cast("double").alias("close"),
        n("YieldRatio").alias("yield_pct"), n("PriceEarningRatio").alias("pe"), n("PriceBookRatio").alias("pb"),
    )
    return out.where(is_listed_share(F.col("code")))
