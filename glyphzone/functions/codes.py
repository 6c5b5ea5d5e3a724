"""Country codes of travel documents: the Java runtime's table of ISO 3166, less some territories, and what documents add to it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ISO 3166 codes that the table leaves out, all of territories.
TERRITORIES = "AIA ALA ASM ATA ATF BES BLM BVT CCK COK CXR FLK GGY GLP GUF GUM HMD IMN IOT JEY MAF MNP MSR MTQ MYT NCL NFK NIU PCN PRI PYF REU SGS SHN SJM SPM TCA TKL UMI VGB VIR WLF".split()
#: Names that differ from the runtime's, by code.
NAMES = {
    "ATG": "Antigua and Barbuda", "BIH": "Bosnia and Herzegovina", "BRN": "Brunei Darussalam", "CIV": "Côte d'Ivoire", "COD": "Congo (Democratic Republic of the)", "COG": "Congo", "CPV": "Cabo Verde",
    "FSM": "Micronesia (Federated States of)", "HKG": "Hong Kong", "KNA": "Saint Kitts and Nevis", "KOR": "Korea (Republic of)", "LAO": "Lao People's Democratic Republic", "LCA": "Saint Lucia", "MAC": "Macao", "MMR": "Myanmar",
    "PRK": "Korea (Democratic People's Republic of)", "PSE": "Palestine", "RUS": "Russian Federation", "STP": "Sao Tome and Principe", "SXM": "Sint Maarten (Dutch part)", "SYR": "Syrian Arab Republic", "TTO": "Trinidad and Tobago", "TUR": "Türkiye",
    "USA": "United States of America", "VAT": "Holy See (Vatican City State)", "VCT": "Saint Vincent and the Grenadines", "VNM": "Viet Nam", "CUW": "Curaçao", "CZE": "Czechia", "SWZ": "Eswatini", "MKD": "North Macedonia", "XKX": "Kosovo",
}
#: Codes that ISO 3166 does not have, in order.
EXTRA = [
    ("UTO", "Utopia (ICAO specimen)"), ("D", "Germany"), ("EUE", "European Union"), ("RKS", "Kosovo"),
    ("GBD", "British Overseas Territories Citizen"), ("GBN", "British National (Overseas)"), ("GBO", "British Overseas Citizen"), ("GBP", "British Protected Person"), ("GBS", "British Subject"),
    ("XXA", "Stateless person (1954 Convention)"), ("XXB", "Refugee (1951 Convention)"), ("XXC", "Refugee (other)"), ("XXX", "Unspecified nationality"),
    ("UNO", "United Nations Organization"), ("UNA", "United Nations specialized agency"), ("UNK", "United Nations Interim Administration Mission in Kosovo"), ("XOM", "Sovereign Military Order of Malta"),
    ("XBA", "African Development Bank"), ("XIM", "African Export-Import Bank"), ("XCC", "Caribbean Community (CARICOM)"), ("XCO", "Common Market for Eastern and Southern Africa (COMESA)"), ("XEC", "Economic Community of West African States (ECOWAS)"), ("XPO", "International Criminal Police Organization (INTERPOL)"),
]


def codes(spark: SparkSession) -> list[tuple[int, str, str]]:
    """(ordinal, code, name), ISO codes first, so that of two codes of one name the ISO one comes first."""
    locale = spark.sparkContext._jvm.java.util.Locale
    names = {x.getISO3Country(): x.getDisplayCountry(locale.ENGLISH) for x in (locale("", c) for c in locale.getISOCountries())}
    names = {c: NAMES.get(c, n) for c, n in (names | {"XKX": "Kosovo"}).items() if c not in TERRITORIES}
    return [(i, c, n) for i, (c, n) in enumerate([*sorted(names.items()), *EXTRA])]


def code_table(spark: SparkSession, rows: list[tuple[int, str, str]] | None = None) -> DataFrame:
    """The table, or one of your own, as rows (ordinal, code, name)."""
    return spark.createDataFrame(rows or codes(spark), "ordinal int, code string, name string")


_FOLD = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
#: Rows of a code table up to which it is broadcast.
SMALL = 10_000


def _small(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if len(table.take(SMALL + 1)) <= SMALL else table


def with_name(df: DataFrame, column: str, out: str, table: DataFrame) -> DataFrame:
    """Adds the name of a code: exact, case-sensitive."""
    return df.join(_small(table.select(F.col("code").alias(column), F.col("name").alias(out))), column, "left")


def with_code(df: DataFrame, column: str, out: str, table: DataFrame) -> DataFrame:
    """Adds the first code in table order whose name is the column's but for ASCII case."""
    first = table.groupBy(F.translate("name", *_FOLD).alias("folded")).agg(F.min_by("code", "ordinal").alias(out))
    return df.join(_small(first), F.translate(df[column], *_FOLD) == F.col("folded"), "left").drop("folded")
