"""What the queries share: reading tables, texts with signal in them, and pieces of SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocab as v


#: Tables of texts, on whose rows much work is done.
TEXTS = {"documents", "conversations", "pages"}


def spread(df: DataFrame) -> DataFrame:
    """Rows of a table that is in fewer partitions than there are cores, such as a single file, over all cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    df = spread(df) if name in TEXTS else df
    for f in df.schema.fields:  # time zones are UTC throughout
        if f.dataType.simpleString() == "timestamp_ntz":
            df = df.withColumn(f.name, F.col(f.name).cast("timestamp"))
    return df


#: Beginnings that give invented prose the signals which the classifiers look for. Each row gets one by its key.
PROBES = [
    "Who is Prof. Asha Rao and what is her research area?", "Tell me about Dr. John Smith in computer science", "How do I apply for sabbatical leave?",
    "What is HR-LA-01?", "How do I fill the HR-LA-01 form for leave?", "Am I eligible for medical reimbursement?", "Define provident fund",
    "List the important policies", "what does gratuity mean", "employee resource book rules", "tell me about the FAG", "what is in the forms compendium",
    "What is the latest leave policy this year?", "Show me publications by Professor Mehta on deep learning and IoT", "steps to submit a travel claim form",
    "who can apply for the research grant", "definition of duty leave", "The form CL-7 fields", "What about it?", "and how", "Section B?", "current guideline for conferences",
    "info about Mrs. Rao", "working on robotics and supply chain", "awards received by faculty", "what are the main requirements for approval", "FAC", "Find", "the ERB",
    "requirements for a fellowship contract agreement", "explain the process of clearance", "How to fill form LA-2 for reimbursement", "application TR-9 instructions for travel",
    "Is there a recent handbook or manual", "overview of all forms", "what should i know about leave policies", "professor and journal publication award", "Dr Anil K. Gupta (Head) of finance",
]


def s(text: str) -> str:
    """A SQL string."""
    return "'" + text.replace("'", "''") + "'"


def sql_list(xs: list[str]) -> str:
    return "[" + ", ".join(map(s, xs)) + "]"


def pick(key: Column, xs: list[str]) -> Column:
    return F.element_at(F.array(*(F.lit(x) for x in xs)), (F.pmod(key, F.lit(len(xs))) + 1).cast("int"))


def sql_pick(key: str, xs: list[str]) -> str:
    return f"({sql_list(xs)})[(({key}) % {len(xs)}) + 1]"


#: Word borders and white space are those of ASCII in DuckDB's regular expressions, of Unicode in the functions here.
def ascii_(c: Column) -> Column:
    return F.regexp_replace(c, "[^ -~]", "x")


def sql_ascii(c: str) -> str:
    return f"regexp_replace({c}, '[^ -~]', 'x', 'g')"


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of the conversations, after one of PROBES."""
    df = table(spark, sf_dir, "conversations")
    return df.select("conv_id", "turn", F.concat_ws(" ", pick(F.col("conv_id") * 31 + F.col("turn"), PROBES), ascii_(F.col("text"))).alias("q"))


PROBES_SQL = f"probes AS (SELECT conv_id, turn, concat_ws(' ', {sql_pick('conv_id * 31 + turn', PROBES)}, {sql_ascii('text')}) AS q FROM conversations)"


def squeeze(c: str) -> str:
    return f"trim(regexp_replace({c}, {s(v.WS + '+')}, ' ', 'g'))"


def has(c: str, pattern: str, flags: str = "i") -> str:
    return f"regexp_matches({c}, {s(pattern)}, {s(flags)})" if flags else f"regexp_matches({c}, {s(pattern)})"


def chain(c: str, steps: list[tuple[str, str]], flags: str = "g") -> str:
    for a, b in steps:
        c = f"regexp_replace({c}, {s(a)}, {s(b)}, {s(flags)})"
    return c


def contains_any(c: str, ws: list[str]) -> str:
    return "(" + " OR ".join(f"contains({c}, {s(w)})" for w in ws) + ")"


def tokens(c: str) -> str:
    """The estimate of tokens."""
    q = squeeze(c)
    return f"coalesce(CASE WHEN {q} = '' THEN 0 ELSE floor((length({q}) - length(replace({q}, ' ', '')) + 1) * 1.3::DOUBLE) END, 0)::INTEGER"
