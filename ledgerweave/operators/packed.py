"""Several values packed in one field: split into one row per value, position kept.

The field is split on quote characters; pieces inside quotes are literals, and so is, outside quotes, what stands inside
round brackets, however deep.  The other pieces are split on the separators.  Folds over the array of pieces tell which are
literals, and put the values back together in order: a literal is glued to what stands before and after it, a separator ends
a value.  All of it is built-in array and string expressions; no character of the field is replaced on the way.

Time grows with the length of the text and, as a fold copies what it has gathered, with the square of the number of its quotes
and brackets.

Defined results: null, blank and null-mark fields have no values; empty pieces take no position; unbalanced quotes and
brackets are ordinary characters; repeated (key, field) rows give their values once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Separators seen in the data, quote characters (a straight one not escaped), white space.
STRONG = r"[;；|\n\r\t•]|(?<=\s)//(?=\s)"
COMMA = ","
QUOTE = r'(?<!\\)"|[«»]'
WHITE = r"[\s\x{A0}\x{1680}\x{2000}-\x{200B}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
#: Kinds of pieces.
PLAIN, LITERAL, OPEN, CLOSE = 0, 1, 2, 3
ENCLOSED = r'(?s)\A"((?:[^"\\]|\\"|""|\\(?!"))*+)"\z'
ANGLED = r"\A«([^»]*)»\z"


def trim_white(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{WHITE}+|{WHITE}+$", "")


def _piece(kind, text: Column) -> Column:
    return F.struct((F.lit(kind) if isinstance(kind, int) else kind).alias("k"), text.alias("t"))


def _inside_quotes() -> Column:
    """For each piece between the ``__marks``, whether it stands inside quotes; a quote that is never closed opens nothing.

    With straight quotes alone the odd pieces are inside; where both kinds occur, a fold keeps the one that is open.
    """
    start = F.struct(F.lit("").alias("open"), F.lit(0).alias("i"), F.array(F.lit(False)).alias("flags"))

    def step(a: Column, m: Column) -> Column:
        i, last = a["i"] + 1, F.col("__last")
        opens = F.when((m == '"') & (i < last["straight"]), F.lit('"')).when((m == "«") & (i < last["angled"]) & last["any"], F.lit("»")).otherwise("")
        now = F.when(a["open"] == "", opens).when(a["open"] == m, "").otherwise(a["open"])
        return F.struct(now.alias("open"), i.alias("i"), F.concat(a["flags"], F.array(now != "")).alias("flags"))

    odd = F.transform(F.sequence(F.lit(0), F.col("__n")), lambda i: (i % 2 == 1) & (i < F.col("__n")))
    return F.when(F.exists("__marks", lambda m: m != '"'), F.aggregate("__marks", start, step)["flags"]).otherwise(odd)


def _without_brackets(pieces: Column) -> Column:
    """Pieces as plain ones and literals: matched brackets and all between them are literals, other brackets are plain."""
    # from the right: a bracket opens only if one that closes is left for it
    right = F.aggregate(
        F.reverse(pieces), F.struct(F.lit(0).alias("left"), F.array().cast("array<struct<k:int,t:string>>").alias("out")),
        lambda a, p: F.struct(
            F.when(p["k"] == CLOSE, a["left"] + 1).when((p["k"] == OPEN) & (a["left"] > 0), a["left"] - 1).otherwise(a["left"]).alias("left"),
            F.concat(a["out"], F.array(_piece(F.when((p["k"] == OPEN) & (a["left"] == 0), PLAIN).otherwise(p["k"]), p["t"]))).alias("out"),
        ),
    )["out"]
    return F.aggregate(
        F.reverse(right), F.struct(F.lit(0).alias("depth"), F.array().cast("array<struct<k:int,t:string>>").alias("out")),
        lambda a, p: F.struct(
            F.when(p["k"] == OPEN, a["depth"] + 1).when(p["k"] == CLOSE, F.greatest(a["depth"] - 1, F.lit(0))).otherwise(a["depth"]).alias("depth"),
            F.concat(a["out"], F.array(_piece(F.when((a["depth"] > 0) | p["k"].isin(OPEN, LITERAL), LITERAL).otherwise(PLAIN), p["t"]))).alias("out"),
        ),
    )["out"]


def _pieces(rows: DataFrame) -> DataFrame:
    """Adds ``__pieces``: the text as an array of (k, t), k being ``PLAIN`` or ``LITERAL``; the t joined are the text.

    Arrays that a lambda looks into are columns of their own, so that they are made once and not for every element.
    """
    kind = lambda t: F.when(t == "(", OPEN).when(t == ")", CLOSE).otherwise(PLAIN)
    outside = lambda p: F.transform(F.regexp_extract_all(p, F.lit(r"[()]|[^()]+"), F.lit(0)), lambda t: _piece(kind(t), t))
    none = F.array().cast("array<struct<k:int,t:string>>")
    each = lambda x: F.concat(F.when(x["q"], F.array(_piece(LITERAL, x["p"]))).otherwise(outside(x["p"])), F.when(x["m"].isNotNull(), F.array(_piece(LITERAL, x["m"]))).otherwise(none))
    packed = F.col("__text").rlike(r'["«»()]')
    rows = rows.withColumn("__marks", F.when(packed, F.regexp_extract_all("__text", F.lit(QUOTE), F.lit(0)))).withColumn("__n", F.size("__marks"))
    last = lambda q: F.col("__n") - F.array_position(F.reverse("__marks"), q) + 1
    rows = rows.withColumn("__last", F.struct(last('"').alias("straight"), last("»").alias("angled"), F.array_contains("__marks", "»").alias("any")))
    rows = rows.withColumn("__inside", F.when(packed, _inside_quotes()))
    rows = rows.withColumn("__cut", F.arrays_zip(F.split("__text", QUOTE, -1).alias("p"), F.col("__inside").alias("q"), F.col("__marks").alias("m")))
    rows = rows.withColumn("__quoted", F.flatten(F.transform("__cut", each)))
    flat = F.transform("__quoted", lambda p: _piece(F.when(p["k"] == LITERAL, LITERAL).otherwise(PLAIN), p["t"]))
    found = F.when(F.exists("__quoted", lambda p: p["k"] == OPEN), _without_brackets(F.col("__quoted"))).otherwise(flat)
    rows = rows.withColumn("__pieces", F.when(packed, found).otherwise(F.array(_piece(PLAIN, F.col("__text")))))
    return rows.drop("__marks", "__n", "__last", "__inside", "__cut", "__quoted")


def _values(pieces: Column, regex: str) -> Column:
    """What stands between separators of plain pieces, trimmed, without what is blank."""
    cut = F.transform(pieces, lambda p: F.struct(p["t"].alias("t"), F.when(p["k"] == PLAIN, F.split(p["t"], regex, -1)).alias("parts")))

    def step(a: Column, p: Column) -> Column:
        parts, n = p["parts"], F.size(p["parts"])
        # the first part ends the value so far, the last begins the next one
        done = F.concat(a["out"], F.array(F.concat(a["now"], F.get(parts, F.lit(0)))), F.slice(parts, F.lit(2), n - 2))
        return F.when(n > 1, F.struct(F.get(parts, n - 1).alias("now"), done.alias("out"))).otherwise(F.struct(F.concat(a["now"], p["t"]).alias("now"), a["out"].alias("out")))

    start = F.struct(F.lit("").alias("now"), F.array().cast("array<string>").alias("out"))
    whole = F.aggregate(cut, start, step, lambda a: F.concat(a["out"], F.array(a["now"])))
    return F.filter(F.transform(whole, trim_white), lambda p: p != "")


def _bare(p: Column) -> Column:
    """A value without the quotes that enclose all of it."""
    straight = F.regexp_replace(F.regexp_extract(p, ENCLOSED, 1), r'""|\\"', '"')
    return F.when(p.rlike(ENCLOSED), straight).when(p.rlike(ANGLED), F.regexp_extract(p, ANGLED, 1)).otherwise(p)


def packed_rows(df: DataFrame, field: str, null_mark: str = "-0-") -> DataFrame:
    """``df`` with ``__values``: the values of a packed field in order; null where it has none."""
    text = F.regexp_replace(trim_white(F.col(field)), r"\.\z", "")
    rows = df.withColumn("__text", text).withColumn("__text", F.when((F.col("__text") != "") & (F.col("__text") != null_mark), F.col("__text")))
    rows = _pieces(rows)
    rows = rows.withColumn("__strong", _values(F.col("__pieces"), STRONG))
    # a comma separates only where no other separator stands between values
    parts = F.when(F.size("__strong") > 1, F.col("__strong")).otherwise(_values(F.col("__pieces"), f"{STRONG}|{COMMA}"))
    values = F.filter(F.transform(parts, _bare), lambda p: trim_white(p) != "")
    return rows.withColumn("__values", F.when(F.col("__text").isNotNull(), values)).drop("__text", "__pieces", "__strong")


def split_packed(df: DataFrame, key: str, field: str) -> DataFrame:
    """(key, pos, value): one row per value, pos counting from 1."""
    rows = df.select(F.col(key).alias("__k"), F.col(field).alias("__t")).filter(F.col("__t").isNotNull())
    # the outer form: of the other the optimiser would make a filter that holds all the steps, written out, once more
    out = packed_rows(rows, "__t").select("__k", F.posexplode_outer("__values").alias("pos", "value")).filter("value is not null")
    return out.select(F.col("__k").alias(key), (F.col("pos") + 1).cast("int").alias("pos"), "value").distinct()
