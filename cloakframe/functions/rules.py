"""Fixed rule tables: names, categories, patterns."""

from __future__ import annotations

# The phrases that mark a column name, by type. A phrase is one to three
# words; a name matches if the words stand next to each other in it.
PHRASES: dict[str, list[str]] = {
    "email": ["email", "mail"],
    "phone": ["phone", "mobile", "tel", "fax"],
    "ssn": ["ssn", "social security number"],
    "dob": ["dob", "birth", "birthday", "birthdate", "date of birth"],
    "lob": [
        "birth country", "birth place", "birth city", "birth state", "birth location", "birth town",
        "country of birth", "place of birth", "city of birth", "state of birth", "location of birth",
    ],
    "credit_card": ["card"],
    "cvv": ["cvv", "cvc"],
    "passport": ["passport"],
    "npi": ["npi"],
    "license": ["license", "licence"],
    "ip": ["ip"],
    "salutation": ["salutation"],
    "name": ["surname", "first name", "first names", "last name", "last names", "full name", "given name", "given names", "family name", "family names"],
    "gender": ["gender", "sex"],
    "nationality": ["nationality", "citizenship"],
    "national_id": ["national id"],
    "tax_id": ["tax number", "tax id", "ird number", "tfn", "tax file number", "abn"],
    "visa": ["visa number", "visa id"],
    "resident_id": ["resident number", "resident id"],
    "immigration_id": ["immigration id"],
    "address": ["address", "addr", "street", "postcode", "zip"],
    "gps": ["latitude", "longitude", "gps", "coordinates"],
    "bank_account": ["bank", "bsb", "routing", "account number", "routing number"],
    "iban": ["iban"],
    "swift": ["swift"],
    "expiry": ["expiry"],
    "salary": ["salary", "wage"],
    "job_title": ["job title"],
    "medical": ["medical", "diagnosis", "prescription", "disability", "vaccination", "vaccine"],
    "health": ["health", "medicare", "medicare number", "nhi", "nhi number"],
    "username": ["username"],
    "auth_token": ["auth token"],
    "mac_address": ["mac address"],
    "biometric": ["biometric", "fingerprint", "voiceprint", "retina", "face scan"],
    "next_of_kin": ["next of kin"],
    "emergency_contact": ["emergency contact"],
}

# Words that make "<word> name" or "<word> names" a person's name.
NAME_OWNERS = [
    "contact", "person", "customer", "client", "employee", "member", "patient", "owner", "recipient", "sender",
    "account", "preferred", "middle", "maiden", "spouse", "parent", "guardian", "manager", "sibling", "children",
]

# Words that make "<word> id" or "<word> number" a person's id.
ID_OWNERS = [
    "employee", "staff", "student", "member", "client", "customer", "consumer", "cust", "crm", "person",
    "manager", "user", "device", "session", "cookie", "advertising", "external",
]

# Categories in report order, with their sensitivity weight and types.
CATEGORIES: list[tuple[str, int, list[str]]] = [
    ("Names", 2, ["name", "salutation"]),
    ("Demographics", 1, ["gender", "nationality"]),
    ("Government IDs", 3, ["national_id", "tax_id", "visa", "resident_id", "immigration_id", "passport", "license", "ssn"]),
    ("Contact", 2, ["email", "phone"]),
    ("Date of birth", 2, ["dob"]),
    ("Location of birth", 2, ["lob"]),
    ("Address & location", 1, ["address", "gps"]),
    ("Financial", 3, ["credit_card", "cvv", "iban", "swift", "bank_account", "expiry"]),
    ("Employment", 2, ["salary", "job_title"]),
    ("Health & medical", 3, ["medical", "health", "npi"]),
    ("Online & technical", 1, ["username", "auth_token", "mac_address", "ip", "id"]),
    ("Biometric", 3, ["biometric"]),
    ("Family & relationships", 2, ["next_of_kin", "emergency_contact"]),
]
OTHER = "Other"
NO_PII = "No PII"

# Names that are always on the denylist.
DENYLIST = [
    "email", "ssn", "dob", "phone", "npi", "credit_card", "card_number", "cvv", "passport", "license_number",
    "full_name", "first_name", "last_name", "surname", "birthdate", "salutation", "gender", "nationality", "citizenship", "address",
    "latitude", "longitude", "iban", "salary", "employee_id", "staff_id", "student_id", "national_id", "immigration_id", "medical",
    "biometric", "fingerprint", "prescription", "diagnosis", "vaccination", "disability", "username", "auth_token", "next_of_kin", "emergency_contact",
]

# Value patterns in the order in which they are tried, with their confidence.
PATTERNS: list[tuple[str, str, float]] = [
    ("email", r"(?i)\b[a-z0-9._%+\-]+@[a-z0-9.\-]+\.[a-z]{2,}\b", 0.95),
    ("ssn", r"\b\d{3}-\d{2}-\d{4}\b", 0.90),
    ("phone", r"\b(\+?1[\s.-]?)?\(?\d{3}\)?(?:[\s.\-]\d{3}[\s.\-]\d{4}|\d{7})\b", 0.70),
    ("credit_card", r"\b\d{13,16}\b", 0.65),
    ("health", r"(?i)\b[a-hj-np-z]{3}(?:\d{4}|\d{2}[a-hj-np-z]{2})\b", 0.85),
    ("bank_account", r"\b\d{2}-\d{4}-\d{7}-\d{2,3}\b", 0.85),
    ("phone", r"\b(?:\+61[\s-]?|0)4\d{2}[\s-]?\d{3}[\s-]?\d{3}\b", 0.70),
    ("phone", r"\b(?:\+64[\s-]?|0)2\d[\s-]?\d{3}[\s-]?\d{4,5}\b", 0.70),
    ("passport", r"\b[A-Za-z]{1,2}\d{6,7}\b", 0.70),
    ("license", r"\b[A-Za-z]{2}\d{6}\b", 0.75),
]

# Weights of the check digits.
ABN_WEIGHTS = [10, 1, 3, 5, 7, 9, 11, 13, 15, 17, 19]
MEDICARE_WEIGHTS = [1, 3, 7, 9, 1, 3, 7, 9]
TFN_WEIGHTS = [1, 4, 3, 7, 5, 8, 6, 9, 10]
IRD_WEIGHTS = [3, 2, 7, 6, 5, 4, 3, 2]
IRD_SECOND_WEIGHTS = [7, 4, 3, 2, 5, 2, 7, 6]
NHI_WEIGHTS = [7, 6, 5, 4, 3, 2]
NHI_LETTERS = "ABCDEFGHJKLMNPQRSTUVWXYZ"

CATEGORY_OF = {t: name for name, _, types in CATEGORIES for t in types}
WEIGHT_OF = {name: w for name, w, _ in CATEGORIES} | {OTHER: 0}
RANK_OF = {name: k for k, (name, _, _) in enumerate(CATEGORIES)} | {OTHER: len(CATEGORIES)}
JOINED = {phrase.replace(" ", ""): t for t, phrases in PHRASES.items() for phrase in phrases}
