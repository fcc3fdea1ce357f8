"""Instrument dimension: what each allocation code is."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Code | name | asset group | broad group | market scope | currency exposure | I interest-bearing,
# P participation-compatible, - neither.
INSTRUMENTS = """
bpp | Borsa Istanbul Money Market | Money Market | Money Market | Domestic | TRY | I
hs | Stock | Equity | Equity | Domestic | TRY | P
dt | Government Bond | Government Fixed Income | Fixed Income | Domestic | TRY | I
hb | Treasury Bill | Government Fixed Income | Fixed Income | Domestic | TRY | I
kibd | Government Currency Debt Securities | Government Fixed Income FX | Fixed Income | Domestic | FX | I
fb | Commercial Paper | Private Sector Fixed Income | Fixed Income | Domestic | TRY | I
ost | Private Sector Bond | Private Sector Fixed Income | Fixed Income | Domestic | TRY | I
vdm | Asset-Backed Securities | Structured Fixed Income | Fixed Income | Domestic | TRY | I
gas | Real Estate Certificate | Real Estate | Real Estate / Alternative | Domestic | TRY | P
gyy | Real Estate Investments | Real Estate | Real Estate / Alternative | Domestic | TRY | P
gsyy | Venture Capital Investments | Venture Capital | Venture Capital / Alternative | Domestic | TRY | P
kba | Government Bonds and Bills (FX) | Government Fixed Income FX | Fixed Income | Foreign / International | FX | I
osdb | International Corporate Debt Securities | Foreign Private Sector Fixed Income | Fixed Income | Foreign / International | FX | I
tpp | Takasbank Money Market | Money Market | Money Market | Domestic | TRY | I
kkstl | Government Lease Certificate (Turkish Lira) | Lease Certificate | Lease Certificates | Domestic | TRY | P
kksd | Government Lease Certificate (Foreign Currency) | Lease Certificate FX | Lease Certificates | Domestic | FX | P
osks | Private Sector Lease Certificates | Private Sector Lease Certificate | Lease Certificates | Domestic | TRY | P
kksyd | International Government Lease Certificates | Foreign Lease Certificate | Lease Certificates | Foreign / International | FX | P
oksyd | International Corporate Lease Certificates | Foreign Lease Certificate | Lease Certificates | Foreign / International | FX | P
vmtl | Deposit Account (Turkish Lira) | Deposit | Deposit | Domestic | TRY | I
vmd | Deposit Account (Foreign Currency) | FX Deposit | Deposit | Domestic | FX | I
khtl | Participation Account (Turkish Lira) | Participation Account | Participation Account | Domestic | TRY | P
khd | Participation Account (Foreign Currency) | FX Participation Account | Participation Account | Domestic | FX | P
khau | Participation Account (Gold) | Gold Participation Account | Participation Account | Domestic | Gold | P
r | Repo | Money Market | Money Market | Domestic | TRY | I
tr | Reverse-Repo | Money Market | Money Market | Domestic | TRY | I
btaa | BIST Committed Transactions Market Buy | Money Market | Money Market | Domestic | TRY | P
btas | BIST Committed Transactions Market Sell | Money Market | Money Market | Domestic | TRY | P
km | Precious Metals | Precious Metals | Precious Metals | Commodity / Global Pricing | Gold | P
kmbyf | Exchange Traded Fund Issued in Precious Metals | Precious Metals | Precious Metals | Commodity / Global Pricing | Gold | P
kmkba | Government Debt Securities Issued in Precious Metal | Precious Metals Linked Debt | Precious Metals | Commodity / Global Pricing | Gold | P
kmkks | Government Lease Certificates Issued in Precious Metal | Precious Metals Linked Lease Certificate | Precious Metals | Commodity / Global Pricing | Gold | P
ybkb | International Government Debt Securities | Foreign Government Fixed Income | Fixed Income | Foreign / International | FX | I
ybosb | International Corporate Debt Securities | Foreign Private Sector Fixed Income | Fixed Income | Foreign / International | FX | I
yhs | Foreign Equity | Foreign Equity | Foreign Equity | Foreign / International | FX | P
ybyf | International Exchange Traded Fund | Foreign ETF | Foreign ETF | Foreign / International | FX | -
yyf | Investment Funds Participation Share | Investment Fund | Fund | Look-through Required | Look-through Required | -
byf | Exchange Traded Fund Participation Share | ETF | ETF | Look-through Required | Look-through Required | -
gykb | Real Estate Investment Fund Participation Share | Real Estate Fund | Real Estate / Alternative | Look-through Required | Look-through Required | P
gsykb | Venture Capital Investment Fund Participation Share | Venture Capital Fund | Venture Capital / Alternative | Look-through Required | Look-through Required | P
db | FX Payable Bills | Government Fixed Income FX | Fixed Income | Foreign / International | FX | I
dot | Foreign Currency Bills | Government Fixed Income FX | Fixed Income | Foreign / International | FX | I
bb | Bank Bills | Private Sector Fixed Income | Fixed Income | Domestic | TRY | I
eut | Eurobonds | Eurobond | Fixed Income | Foreign / International | FX | I
kks | Government Lease Certificates | Lease Certificate | Lease Certificates | Domestic | TRY | P
vm | Term Deposit | Deposit | Deposit | Domestic | TRY | I
vmau | Deposit Account (Gold) | Gold Deposit | Deposit | Domestic | Gold | I
kh | Participation Account | Participation Account | Participation Account | Domestic | TRY | P
ymk | Foreign Securities | Foreign Securities | Foreign Securities | Foreign / International | FX | -
yba | Foreign Debt Instruments | Foreign Government Fixed Income | Fixed Income | Foreign / International | FX | I
fkb | Fund Participation Certificate | Investment Fund | Fund | Look-through Required | Look-through Required | -
t | Derivatives | Derivatives | Derivatives | Other / Unknown | Mixed / Unknown | -
vint | Futures Contract Cash Collateral | Derivative Collateral | Money Market / Collateral | Operational / Cash-like | Operational / Collateral | -
d | Other | Other | Other | Other / Unknown | Other / Unknown | -
"""

COLUMNS = ("code", "name_en", "asset_group", "broad_group", "market_scope", "currency", "screen")
ROWS = [tuple(x.strip() for x in line.split("|")) for line in INSTRUMENTS.strip().splitlines()]
BROAD_GROUPS = sorted({r[3] for r in ROWS})
SCOPES = sorted({r[4] for r in ROWS})
CURRENCIES = sorted({r[5] for r in ROWS})

# Broad groups that grow with markets, those to look through, families by broad group.
GROWTH_GROUPS = ("Equity", "Foreign Equity", "Precious Metals", "Real Estate / Alternative", "Venture Capital / Alternative")
LOOKTHROUGH_GROUPS = ("Fund", "ETF", "Foreign ETF")


def instruments(spark: SparkSession) -> DataFrame:
    """The dimension as a DataFrame of 54 rows."""
    return spark.createDataFrame(ROWS, ", ".join(f"{c} string" for c in COLUMNS))


def unknown_codes(allocation: DataFrame) -> DataFrame:
    """Codes of a long allocation that the dimension lacks, with their rows."""
    known = instruments(allocation.sparkSession).select("code")
    return allocation.join(known, "code", "left_anti").groupBy("code").count()
