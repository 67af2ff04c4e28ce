"""Fixed values of the evidence model: number words, units, attribute keywords and plausible ranges. All are data and can be replaced."""

# Factors of number words.
MULTIPLIERS = {
    "thousand": 1e3, "'000": 1e3, "lakh": 1e5, "lac": 1e5, "lakhs": 1e5, "lacs": 1e5, "million": 1e6, "mn": 1e6,
    "crore": 1e7, "crores": 1e7, "cr": 1e7, "billion": 1e9, "bn": 1e9,
}

# Unit phrases with their canonical unit and factor.
UNITS = {
    "t": ("tonnes", 1.0), "tonne": ("tonnes", 1.0), "tonnes": ("tonnes", 1.0), "ton": ("tonnes", 1.0), "tons": ("tonnes", 1.0),
    "mt": ("tonnes", 1e6), "mnt": ("tonnes", 1e6), "million tonnes": ("tonnes", 1e6), "million tonne": ("tonnes", 1e6),
    "lt": ("tonnes", 1e5), "lakh tonnes": ("tonnes", 1e5), "lakh tonne": ("tonnes", 1e5),
    "kt": ("tonnes", 1e3), "'000 tonnes": ("tonnes", 1e3), "thousand tonnes": ("tonnes", 1e3), "'000 t": ("tonnes", 1e3),
    "%": ("percent", 1.0), "percent": ("percent", 1.0), "pct": ("percent", 1.0), "kcal/kg": ("kcal/kg", 1.0), "kcal per kg": ("kcal/kg", 1.0),
    "cu.m": ("cubic metres", 1.0), "cum": ("cubic metres", 1.0), "cubic metre": ("cubic metres", 1.0), "cubic metres": ("cubic metres", 1.0),
    "cubic meters": ("cubic metres", 1.0), "m3": ("cubic metres", 1.0), "mcm": ("million cubic metres", 1e6),
    "ha": ("hectares", 1.0), "hectare": ("hectares", 1.0), "hectares": ("hectares", 1.0), "sq km": ("sq km", 1.0), "km2": ("sq km", 1.0), "km": ("km", 1.0),
    "m": ("metres", 1.0), "metres": ("metres", 1.0), "meters": ("metres", 1.0), "mt/day": ("tonnes/day", 1e6), "tpa": ("tonnes/annum", 1.0), "mtpa": ("tonnes/annum", 1e6),
    "rs": ("rupees", 1.0), "rs.": ("rupees", 1.0), "inr": ("rupees", 1.0),
}

# Attributes and the keywords that name them.
ATTRIBUTES = {
    "production": ["production", "produced", "output"],
    "offtake": ["offtake", "off take", "despatch", "dispatch", "lifted", "supplied"],
    "reserves": ["reserves", "reserve", "geological reserves", "extractable reserve", "mineable reserve", "in-situ"],
    "gcv": ["gcv", "gross calorific", "calorific value", "calorific"],
    "ash_pct": ["ash", "ash content", "% ash"],
    "moisture_pct": ["moisture"],
    "depth": ["depth", "seam thickness", "thickness"],
    "drilling": ["drilling", "drilled", "borehole", "exploration drilling"],
    "stripping_ratio": ["stripping ratio", "ob ratio", "o.b. ratio"],
    "area": ["area", "lease hold", "leasehold", "extent"],
    "manpower": ["manpower", "employees", "workforce", "men on roll"],
    "profit": ["profit", "profit before tax", "pbt", "operating profit", "obf"],
    "revenue": ["revenue", "turnover", "sales value", "income"],
    "grade": ["grade of coal", "coal grade"],
    "growth_pct": ["growth"],
    "share_pct": ["share"],
}

# Plausible ranges of attributes.
RANGES = {"ash_pct": (0, 100), "moisture_pct": (0, 100), "share_pct": (0, 100), "growth_pct": (-100, 500), "gcv": (500, 12000), "stripping_ratio": (0, 20), "depth": (0, 3000)}

# First letters of the months' names.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]

# Cells that say that there is no value.
NO_VALUE = ["nil", "na", "n/a", "-", "—"]

# Words that carry no topic.
STOPWORDS = ["the", "and", "for", "with", "that", "this", "from", "was", "were", "are", "has", "have", "had", "been", "will", "which", "their", "its", "into", "than", "not", "per"]

# Words of questions that ask for analysis (patterns).
ANALYTICAL = [
    "compare", "comparison", "share", "shares", "percentage", "percent", "growth", "trend", "chart", "charts", "graph", "plot", "visuali[sz]e", "analysis", "analyse", "analyze",
    "average", "correlation", "distribution", "aggregate", "total", "rank", "ranking", "highest", "lowest", "year.over.year", "statistics", "statistical",
]
