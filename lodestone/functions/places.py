"""Local currency and canonical name of a place. Fixed value tables, which callers may replace."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Currency of a country or city.
CURRENCIES = {
    "saudi": "SAR", "saudi arabia": "SAR", "ksa": "SAR", "riyadh": "SAR", "jeddah": "SAR", "dammam": "SAR", "khobar": "SAR",
    "uae": "AED", "united arab emirates": "AED", "emirates": "AED", "dubai": "AED", "abu dhabi": "AED", "sharjah": "AED", "ajman": "AED",
    "qatar": "QAR", "doha": "QAR", "kuwait": "KWD", "kuwait city": "KWD", "bahrain": "BHD", "manama": "BHD", "oman": "OMR", "muscat": "OMR",
    "egypt": "EGP", "cairo": "EGP", "alexandria": "EGP",
    "india": "INR", "bangalore": "INR", "bengaluru": "INR", "delhi": "INR", "new delhi": "INR", "ncr": "INR", "gurgaon": "INR", "gurugram": "INR", "noida": "INR",
    "mumbai": "INR", "pune": "INR", "hyderabad": "INR", "chennai": "INR", "kolkata": "INR", "ahmedabad": "INR",
    "pakistan": "PKR", "karachi": "PKR", "lahore": "PKR", "islamabad": "PKR", "bangladesh": "BDT", "dhaka": "BDT", "sri lanka": "LKR", "colombo": "LKR",
    "uk": "GBP", "united kingdom": "GBP", "britain": "GBP", "great britain": "GBP", "england": "GBP", "scotland": "GBP", "wales": "GBP", "london": "GBP", "manchester": "GBP", "birmingham": "GBP", "edinburgh": "GBP",
    "germany": "EUR", "berlin": "EUR", "munich": "EUR", "frankfurt": "EUR", "hamburg": "EUR", "france": "EUR", "paris": "EUR", "lyon": "EUR", "netherlands": "EUR", "amsterdam": "EUR", "rotterdam": "EUR",
    "ireland": "EUR", "dublin": "EUR", "spain": "EUR", "madrid": "EUR", "barcelona": "EUR", "italy": "EUR", "milan": "EUR", "rome": "EUR", "switzerland": "CHF", "zurich": "CHF", "geneva": "CHF",
    "poland": "PLN", "warsaw": "PLN", "sweden": "SEK", "stockholm": "SEK", "norway": "NOK", "oslo": "NOK", "denmark": "DKK", "copenhagen": "DKK",
    "united states": "USD", "usa": "USD", "us": "USD", "america": "USD", "canada": "CAD", "toronto": "CAD", "vancouver": "CAD", "montreal": "CAD", "ottawa": "CAD", "calgary": "CAD", "brazil": "BRL", "mexico": "MXN",
    "singapore": "SGD", "australia": "AUD", "sydney": "AUD", "melbourne": "AUD", "brisbane": "AUD", "perth": "AUD", "new zealand": "NZD", "auckland": "NZD", "japan": "JPY", "tokyo": "JPY", "osaka": "JPY",
    "south korea": "KRW", "korea": "KRW", "seoul": "KRW", "hong kong": "HKD", "taiwan": "TWD", "malaysia": "MYR", "kuala lumpur": "MYR", "indonesia": "IDR", "jakarta": "IDR", "philippines": "PHP", "manila": "PHP",
    "thailand": "THB", "bangkok": "THB", "vietnam": "VND", "south africa": "ZAR",
}
# Names that together leave the currency open.
SAUDI = ["saudi", "riyadh", "jeddah", "dammam", "ksa"]
EMIRATES = ["uae", "dubai", "abu dhabi", "sharjah", "emirates"]
# Canonical names of aliases that the general rule would not give.
NAMES = {"saudi": "Saudi Arabia", "ksa": "Saudi Arabia", "neom": "NEOM", "united arab emirates": "UAE", "emirates": "UAE", "united kingdom": "UK", "us": "USA", "usa": "USA", "united states": "USA"}


def lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.map_from_arrays(F.array(*map(F.lit, table)), F.array(*map(F.lit, table.values()))), key)


def local_currency(place: Column, default: str | None = "USD") -> Column:
    """Currency of a place: names of several words before single ones, the first single one in the text; null where several regions are named."""
    low = F.lower(place)
    one_of = lambda names: F.exists(F.array(*map(F.lit, names)), lambda n: F.contains(low, n))
    phrases = [k for k in CURRENCIES if " " in k]
    phrase = F.coalesce(*[F.when(F.contains(low, F.lit(k)), CURRENCIES[k]) for k in phrases])
    words = F.regexp_extract_all(low, F.lit("[a-zA-Z]+"), 0)
    word = F.get(F.filter(F.transform(words, lambda w: lookup(CURRENCIES, w)), lambda x: x.isNotNull()), F.lit(0))
    open_ = F.contains(low, F.lit(" or ")) | (one_of(SAUDI) & one_of(EMIRATES))
    return F.when(F.coalesce(low, F.lit("")) == "", F.lit(default)).when(open_, F.lit(None)).otherwise(F.coalesce(phrase, word, F.lit(default)))


def canonical_name(place: Column) -> Column:
    """Canonical name of a place; others in title case, and short ones in upper case. Null gives an empty string."""
    clean = F.trim(F.coalesce(place, F.lit("")))
    parts = F.regexp_extract_all(F.lower(clean), F.lit(r"(\p{L}+|\P{L}+)"), 1)
    title = F.array_join(F.transform(parts, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))), "")
    return F.coalesce(lookup(NAMES, F.lower(clean)), F.when(F.length(clean) > 3, title).otherwise(F.upper(clean)))
