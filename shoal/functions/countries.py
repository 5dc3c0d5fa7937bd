"""Country codes of free-text and store-region strings, over an alias table that callers may replace."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shoal.functions.exprs import let

# Countries where the network is blocked, so that a foreign connection is expected.
BLOCKED = ("CN", "IR", "KP", "MM", "RU", "TM", "TZ", "VE")

# Country names and a few large cities, lower case.
ALIASES = {
    "united states": "US", "usa": "US", "america": "US", "new york": "US", "los angeles": "US", "california": "US", "texas": "US", "florida": "US", "chicago": "US", "san francisco": "US",
    "united kingdom": "GB", "uk": "GB", "england": "GB", "scotland": "GB", "london": "GB", "ireland": "IE", "dublin": "IE",
    "germany": "DE", "deutschland": "DE", "berlin": "DE", "munich": "DE", "hamburg": "DE", "austria": "AT", "vienna": "AT", "switzerland": "CH", "zurich": "CH",
    "france": "FR", "paris": "FR", "spain": "ES", "madrid": "ES", "barcelona": "ES", "portugal": "PT", "lisbon": "PT", "italy": "IT", "rome": "IT", "milan": "IT",
    "netherlands": "NL", "the netherlands": "NL", "amsterdam": "NL", "belgium": "BE", "brussels": "BE", "sweden": "SE", "norway": "NO", "denmark": "DK", "finland": "FI", "poland": "PL", "warsaw": "PL",
    "russia": "RU", "russian federation": "RU", "moscow": "RU", "москва": "RU", "россия": "RU", "ukraine": "UA", "kyiv": "UA", "київ": "UA", "україна": "UA", "belarus": "BY",
    "turkey": "TR", "istanbul": "TR", "greece": "GR", "romania": "RO", "hungary": "HU", "czech republic": "CZ", "serbia": "RS", "bulgaria": "BG", "georgia": "GE",
    "china": "CN", "beijing": "CN", "shanghai": "CN", "hong kong": "HK", "taiwan": "TW", "japan": "JP", "tokyo": "JP", "south korea": "KR", "korea": "KR", "seoul": "KR", "north korea": "KP", "singapore": "SG",
    "india": "IN", "mumbai": "IN", "delhi": "IN", "pakistan": "PK", "bangladesh": "BD", "indonesia": "ID", "jakarta": "ID", "malaysia": "MY", "philippines": "PH", "manila": "PH", "thailand": "TH", "vietnam": "VN", "myanmar": "MM",
    "iran": "IR", "iraq": "IQ", "israel": "IL", "saudi arabia": "SA", "united arab emirates": "AE", "uae": "AE", "dubai": "AE", "turkmenistan": "TM", "kazakhstan": "KZ",
    "afghanistan": "AF", "albania": "AL", "algeria": "DZ", "armenia": "AM", "azerbaijan": "AZ", "bolivia": "BO", "cambodia": "KH", "cameroon": "CM", "costa rica": "CR", "croatia": "HR",
    "cyprus": "CY", "dominican republic": "DO", "ecuador": "EC", "estonia": "EE", "ethiopia": "ET", "iceland": "IS", "jordan": "JO", "kuwait": "KW", "latvia": "LV", "lebanon": "LB",
    "libya": "LY", "lithuania": "LT", "luxembourg": "LU", "nepal": "NP", "oman": "OM", "panama": "PA", "paraguay": "PY", "qatar": "QA", "senegal": "SN", "slovakia": "SK",
    "slovenia": "SI", "somalia": "SO", "sri lanka": "LK", "sudan": "SD", "syria": "SY", "tunisia": "TN", "uganda": "UG", "uruguay": "UY", "uzbekistan": "UZ", "yemen": "YE", "zimbabwe": "ZW",
    "egypt": "EG", "cairo": "EG", "nigeria": "NG", "lagos": "NG", "kenya": "KE", "nairobi": "KE", "south africa": "ZA", "tanzania": "TZ", "morocco": "MA", "ghana": "GH",
    "canada": "CA", "toronto": "CA", "mexico": "MX", "brazil": "BR", "brasil": "BR", "argentina": "AR", "chile": "CL", "colombia": "CO", "peru": "PE", "venezuela": "VE", "caracas": "VE", "cuba": "CU", "australia": "AU", "sydney": "AU", "new zealand": "NZ",
}

# Store suffixes of a sign-up source.
SUFFIX = r"(?i)\s+(android app|app store|google play|ios app|web|play store|android|ios|iphone app)\s*$"
# Fixed value: what parts a free-text location.
SPLIT = r"[,|/·•;()\[\]]+|\s+-\s+|\s+–\s+"


def _lookup(aliases: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in sorted(aliases.items()) for x in pair))


def flags(text: Column) -> Column:
    """Codes of flag emoji: pairs of regional indicators."""
    pairs = F.regexp_extract_all(text, F.lit(r"([\x{1F1E6}-\x{1F1FF}]{2})"), F.lit(1))
    code = lambda p: F.translate(p, "".join(chr(0x1F1E6 + i) for i in range(26)), "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    return F.transform(pairs, lambda p: F.when(code(p) == "UK", "GB").otherwise(code(p)))


def strict(text: Column, aliases: dict[str, str] = ALIASES) -> Column:
    """Sorted codes when the whole string, store suffix aside, is one name; else those of its flags. Null gives none."""
    text = F.coalesce(text, F.lit(""))
    name = F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"[.!]+$", ""), SUFFIX, ""))
    code = F.try_element_at(_lookup(aliases), name)
    return F.when(code.isNotNull(), F.array(code)).otherwise(F.array_sort(F.array_distinct(flags(text))))


def free(text: Column, aliases: dict[str, str] = ALIASES) -> Column:
    """Sorted codes in free text: flags, and the whole string or its parts as names; failing all, the longest name of 4 or more characters standing as a word."""
    text = F.coalesce(text, F.lit(""))
    return let(F.regexp_replace(F.lower(F.trim(text)), r"[.!]+$", ""), lambda t: _free(text, t, aliases))


def _free(text: Column, t: Column, aliases: dict[str, str]) -> Column:
    """t: the lower-case text, computed once."""
    table = _lookup(aliases)
    whole = F.try_element_at(table, t)
    parts = F.filter(F.transform(F.split(t, SPLIT), lambda p: F.try_element_at(table, F.regexp_replace(F.trim(p), r"[.!]+$", ""))), lambda c: c.isNotNull())
    near = F.concat(flags(text), F.when(whole.isNotNull(), F.array(whole)).otherwise(parts))
    spaced = F.concat(F.lit(" "), F.regexp_replace(t, r"[^\p{L}\p{N}_]+", " "), F.lit(" "))
    by_length = sorted((a for a in aliases if len(a) >= 4), key=lambda a: (-len(a), a))
    words = F.array(*(F.struct(F.lit(f" {n} ").alias("n"), F.lit(aliases[n]).alias("c")) for n in by_length))
    found = let(spaced, lambda s: F.filter(words, lambda w: s.contains(w["n"])))
    longest = F.transform(F.slice(found, 1, 1), lambda w: w["c"])
    return F.array_sort(F.array_distinct(let(near, lambda n: F.when(F.size(n) > 0, n).otherwise(longest))))
