"""Synthetic tokens: products of the script's letters, as cross joins of small constant tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The letters and their combinations from which tokens are made.
CONSONANTS = [chr(c) for c in range(0x1780, 0x17A3)]
INDEPENDENT = [chr(c) for c in range(0x17A3, 0x17B6)]
VOWELS = [chr(c) for c in range(0x17B6, 0x17C6)] + ["ុំ", "ំ", "ាំ", "ះ", "ិះ", "ុះ", "េះ", "ោះ", "ៈ"]
DIACRITICS = [chr(c) for c in range(0x17C9, 0x17D2)]
DIGITS = [chr(c) for c in range(0x17E0, 0x17EA)]
COENG = chr(0x17D2)
# The shorter lists for clusters with vowel and diacritic.
LIMITED_VOWELS = ["ា", "ិ", "ី", "ុ", "ូ", "េ", "ោ"]
LIMITED_DIACRITICS = ["៉", "៊", "់", "័"]


# Documented clusters of three consonants, as strings of their letters.
DOUBLE_PATTERNS = ["សតរ", "ហវរ", "សពរ", "សគរ", "សទរ", "ហគរ", "ហវល", "ងករ", "ងខយ", "ងគរ", "ងកល", "ងឃរ", "ញចរ", "ញជរ", "នទរ", "នធយ", "នតរ", "កតរ", "គញច", "មពរ", "លករ", "ពនរ", "ថនរ"]
TRIPLE_PATTERNS = ["កសម", "ដឋយ", "សករ", "សគវ"]
# The letters of the clusters that are made systematically, and the vowels that follow them.
DOUBLE_BASES = ["ក", "គ", "ង", "ច", "ន", "ប", "ម", "រ", "ល", "ស", "ហ", "អ"]
DOUBLE_MIDDLES = ["ត", "ក", "ព", "គ", "ន", "ម", "ស", "ល"]
DOUBLE_ENDS = ["រ", "ល", "យ", "វ", "ម", "ន"]
TRIPLE_BASES = ["ស", "ក", "ង", "ន"]
TRIPLE_ENDS = ["ករ", "តរ", "ពរ", "គរ", "សម", "កល", "ថយ"]
DOUBLE_VOWELS = ["ា", "ិ", "ី", "ឹ", "ឺ", "ុ", "ូ", "ួ", "ើ", "េ", "ោ", "ៅ"]
TRIPLE_VOWELS = ["ា", "ិ", "ី", "ឹ", "ឺ", "ុ", "ូ", "េ", "ោ"]
# Documented words.
DOCUMENTED = [
    "ស្ត្រី", "សាស្ត្រ", "សាស្ត្រា", "ហ្វ្រង្ក", "ហ្វ្រ័ង្ក", "ស្ព្រីង", "ស្គ្រីន", "ស្ទ្រីត", "ហ្គ្រីន", "ហ្វ្លាស", "អង្ក្រង", "សង្ខ្យា", "សង្គ្រោះ", "អង្គ្លេស", "សង្ឃ្រាជ", "ចិញ្ច្រាំ", "កញ្ជ្រោង",
    "កន្ទ្រាញ", "សន្ធ្យា", "កន្ត្រៃ", "កន្ត្រ", "តារាសាស្ត្រ", "សុរេន្ទ្រ", "ភក្ត្រ", "លក្ស្មី", "បិដ្ឋ្យដ្ឋិក\u200bសត្វ", "សំស្ក្រឹត", "ប៊ិស្គ្វីត៍", "គញ្ច្រែង", "គញ្ច្រ", "មព្រ", "លក្រ", "ពន្រ", "ថន្រ",
]


def letters(spark: SparkSession, values: list[str], name: str) -> DataFrame:
    """A table of a few fixed letters; one row is exploded, so nothing is shipped from the driver."""
    return spark.range(1).select(F.explode(F.array(*map(F.lit, values))).alias(name))


def families(spark: SparkSession) -> dict[str, DataFrame]:
    """The token families (token), by name."""
    c, v, d, i, n = (letters(spark, x, k) for x, k in ((CONSONANTS, "c"), (VOWELS, "v"), (DIACRITICS, "d"), (INDEPENDENT, "i"), (DIGITS, "n")))
    sub = letters(spark, CONSONANTS, "s")
    join = lambda *parts: reduce(lambda a, b: a.crossJoin(b), parts)
    token = lambda df, *names: df.select(F.concat(*(F.lit(COENG) if x == "+" else F.col(x) for x in names)).alias("token"))
    cluster = join(c, sub).where("c <> s")
    m = n.withColumnRenamed("n", "m")
    return {
        "consonant": token(c, "c"),
        "consonant_vowel": token(join(c, v), "c", "v"),
        "consonant_vowel_diacritic": token(join(c, v, d), "c", "v", "d"),
        "consonant_diacritic": token(join(c, d), "c", "d"),
        "independent": token(i, "i").union(token(join(i, d), "i", "d")),
        "cluster": token(cluster, "c", "+", "s"),
        "cluster_vowel": token(join(cluster, v), "c", "+", "s", "v"),
        "cluster_vowel_diacritic": token(
            join(letters(spark, CONSONANTS[:15], "c"), letters(spark, CONSONANTS[:10], "s"), letters(spark, LIMITED_VOWELS, "v"), letters(spark, LIMITED_DIACRITICS, "d")).where("c <> s"), "c", "+", "s", "v", "d"
        ),
        "digits": token(n, "n").union(token(join(n, m), "n", "m")),
        "double": with_vowels(spark, double_clusters(spark), DOUBLE_VOWELS),
        "triple": with_vowels(spark, triple_clusters(spark), TRIPLE_VOWELS),
        "documented": letters(spark, DOCUMENTED, "token"),
    }


def patterned(spark: SparkSession, patterns: list[str]) -> DataFrame:
    """Clusters (token) of given consonant triples, strings of three letters."""
    part = lambda i: F.substring("p", i, 1)
    return letters(spark, patterns, "p").select(F.concat(part(1), F.lit(COENG), part(2), F.lit(COENG), part(3)).alias("token"))


def double_clusters(spark: SparkSession) -> DataFrame:
    """The documented clusters of three consonants and all products of bases, middles and ends that differ from each other."""
    made = letters(spark, DOUBLE_BASES, "a").crossJoin(letters(spark, DOUBLE_MIDDLES, "b")).crossJoin(letters(spark, DOUBLE_ENDS, "c")).where("a <> b and a <> c and b <> c")
    return patterned(spark, DOUBLE_PATTERNS).union(made.select(F.concat("a", F.lit(COENG), "b", F.lit(COENG), "c"))).distinct()


def triple_clusters(spark: SparkSession) -> DataFrame:
    """The documented rare clusters and those of few bases with given pairs of other consonants."""
    made = letters(spark, TRIPLE_BASES, "a").crossJoin(letters(spark, TRIPLE_ENDS, "e")).where("instr(e, a) = 0")
    return patterned(spark, TRIPLE_PATTERNS).union(made.select(F.concat("a", F.lit(COENG), F.substring("e", 1, 1), F.lit(COENG), F.substring("e", 2, 1)))).distinct()


def with_vowels(spark: SparkSession, clusters: DataFrame, vowels: list[str]) -> DataFrame:
    """Clusters (token), alone and with each vowel."""
    return clusters.union(clusters.crossJoin(letters(spark, vowels, "v")).select(F.concat("token", "v")))


#: The families that each flag adds; the last one needs both its flags.
CLUSTERS, COMPLEX, MULTI = ("cluster", "cluster_vowel"), ("consonant_vowel_diacritic", "cluster_vowel_diacritic"), ("double", "triple", "documented")


def all_tokens(spark: SparkSession, clusters: bool = True, complex_: bool = True, multi: bool = True) -> DataFrame:
    """The distinct tokens of all families that the flags leave in."""
    out = set()
    if not clusters:
        out |= {*CLUSTERS, "cluster_vowel_diacritic"}
    if not complex_:
        out |= set(COMPLEX)
    if not multi:
        out |= set(MULTI)
    return reduce(lambda a, b: a.union(b), (d for k, d in families(spark).items() if k not in out)).distinct()


def ordered(tokens: DataFrame, by_length: bool = True) -> DataFrame:
    """Tokens by length and then by code points, or by code points alone."""
    return tokens.orderBy(*([F.length("token")] if by_length else []), "token")
