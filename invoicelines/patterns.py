"""Patterns and words of the invoice layouts.

All regular expressions are prefixed by `u()`, so that white space, digits, word
borders and ignored case are Unicode's and only a line feed ends a line.
"""

from __future__ import annotations

import re


def u(pattern: str, flags: str = "") -> str:
    """A pattern with Unicode classes and line-feed line ends, and more flags (i, m, s)."""
    return f"(?dU{flags}){pattern}"


def of_upper(patterns: tuple[str, ...]) -> str:
    """Any of the patterns, in an upper-cased text, case ignored. Greek capitals alone are compared as they are, and only where one of their first letters is, which is much faster: only the ohm sign, a capital of its own, is another form of one."""
    joined = "|".join(patterns)
    if not re.fullmatch(r"(?:[Α-Ω|]|\\s\+|\\\.)*", joined):
        return u(joined, "i")
    first = "".join(sorted({p[0] for p in patterns if p}))
    lead = f"(?=[{first}])" if all(re.match("[Α-Ω]", p) for p in patterns) else ""
    return u((f"{lead}(?:{joined})" if lead else joined).replace("Ω", "[Ω\u2126]"))


# Fixed values of the layouts.
ROW1 = r"(\d{10,11})\s+(\d{9,12})\s+(\d{2}/\d{2}/\d{4})\s+(\d{2}\.\d{2}\.\d{4}-\d{2}\.\d{2}\.\d{4})\s+(.+?)\s{2,}(.+?)\s{2,}(.+)$"
ROW2 = r"^(ΦΟΠ|Φ\.Ο\.Π|Φ\s+Ο\s+Π|Γ\d+)\s+(Τιμολόγιο|Επαγγελματικό)\b"
WRAP = r"^(Γ\d+)(?:\s+(.+))?$"
ROW3 = r"^Ημέρα\s+(\d+)\s+(\d+)\s+(\d+)\s+(\d+)\s*$"
ROW3_BARE = r"^(\d+)\s+(\d+)\s+(\d+)\s+(\d+)\s*$"
STORE = r"ΚΑΤΑΣΤΗΜΑ\s+ΕΞΥΠΗΡ\.ΔΕΗ\s*:\s*(.+)"
RECEIPT = r"ΠΑΡΑΣΤ:\s*(\d+)"
SUMMARY = r"Σ\s+Υ\s+Ν\s+Ο\s+Λ\s+Α\s+Π\s+Ο\s+Λ\s+Λ\s+Α\s+Π\s+Λ\s+Ο\s+Υ"
HEADERS = (r"ΔΗΜΟΣΙΑ\s+ΕΠΙΧΕΙΡΗΣΗ\s+ΗΛΕΚΤΡΙΣΜΟΥ", r"ΗΜΕΡΟΛΟΓΙΟ\s+ΕΚΔΟΣΗΣ", r"ΚΩΔ\.ΠΟΛΛΑΠΛΟΥ", r"ΚΩΔ\.ΕΤΑΙΡΟΥ", r"ΟΝΟΜΑ\s+ΔΗΜΟΥ", r"ΑΦΜ")
TOTALS = (r"ΣΥΝΟΛΟ\s+ΠΛΗΡΩΤΕΟ", r"ΠΡΟΗΓΟΥΜΕΝΟ\s+ΥΠΟΛΟΙΠΟ", r"ΕΝΤΟΚΟΣ\s+ΥΠΟΛΟΙΠΟ", r"ΠΕΡΙΟΔΟΣ\s+ΚΑΤΑΝΑΛΩΣΗΣ")
ENHANCED_TOTALS = (r"ΦΠΑ", r"ΣΥΝΟΛΟ", r"ΠΛΗΡΩΤΕΟ", r"ΕΞΟΦΛΗΣΗ")
RESIDENTIAL, COMMERCIAL, WRAP_CODE, TARIFF = "ΦΟΠ", "Επαγγελματικό", "Γ-wrap", "Τιμολόγιο"
RESIDENTIAL_CODES = ("ΦΟΠ", "Φ.Ο.Π", "Φ Ο Π")
FARMING, SIMPLE, INDUSTRIAL, FARMING_WORD = "Αγροτικό", "Απλό επαγγελματικό", "Βιομηχανικό", "ΑΓΡ"
FINAL = "ΕΚΚΑΘΑΡΙΣΤΙΚΟΣ"
TAX_ID = "αφμ"
TRUE_WORDS = ("true", "1", "yes", "ναι", "t", "y")
#: Replaced in this order after doubled characters are collapsed.
REPAIRS = (("ΑΑ", "Α"), ("ρρ", "ρ"), ("ΠΠ", "Π"), ("αα", "α"), ("ρορο", "ρο"), ("χχήήςς", "χής"), ("χχήής", "χής"), ("χχής", "χής"))
ANCHORS = (r"Ο\s+λογαριασμός\s+σας\s+συνοπτικ[άα]", r"Κωδικός\s+Ηλεκτρονικής\s+Πληρωμής", r"Κατανάλωση\s+Ηλεκτρικής\s+Ενέργειας")
SUPPLY = (r"(\d\s+\d{10}[-\s]\d{1,2})", r"(\d{1,2}\s+\d{10,11}[-\s]\d{1,2})", r"(\d{12})")
NAME = (r"(ΔΗΜΟΣ\s+[A-ZΆ-ώ\s]+?(?=\s|$))", r"([A-ZΆ-ώ]+\s+[A-ZΆ-ώ\s]+?(?=\s|$))")
NAME_TAILS = (r"\s+Τιμολόγιο.*$", r"\s+ΦΟΠ.*$", r"\s+ΑΓ\s*$")
TOWNS = ("ΛΑΣ", "ΑΘΗΝΑ", "ΘΕΣΣΑΛΟΝΙΚΗ")
ADDRESS = (r"Διεύθυνση\s+Ακινήτου\s+([A-ZΆ-ώ\s]+?)(?:\s|$)", r"(\d{3}\s+\d{2}\s+[A-ZΆ-ώ\s]+(?:ΛΑΣ|ΑΘΗΝΑ|ΘΕΣΣΑΛΟΝΙΚΗ))", r"(ΑΓ\.\s*[A-ZΆ-ώ\s]+?(?=\s|$))", r"([A-ZΆ-ώ\s]+(?:ΛΑΣ|ΑΘΗΝΑ|ΘΕΣΣΑΛΟΝΙΚΗ))")
ISSUED, ANY_DATE = r"Ημερομηνία\s+Έκδοσης", r"(\d{2}/\d{2}/\d{4})"
PERIOD = r"(\d{2}/\d{2}/\d{4}\s*-\s*\d{2}/\d{2}/\d{4})"
SPAN = r"(\d{2}[/-]\d{2}[/-]\d{4})\s*[-–]\s*(\d{2}[/-]\d{2}[/-]\d{4})"
# Numbers begin where none is before them and never give back what they took, so a text is searched once and not from every digit to its number's end.
# What must follow a value is looked at and not taken, so that the value is the whole match: see found().
KWH = r"(\d(?<!\d\d)[\d\.\s]*+(?=kWh))"
STARRED, EURO = r"(\*[\d\.\,]+)", r"([\d\.\,](?<![\d\.\,]{2})[\d\.\,]*+(?=\s*+€\s*$))"
PAYMENT = r"(RF\d{2}(?:\s*\d{4}){5}\s*\d?)"
CITY = r"(\d{3}\s+\d{2}\s+[A-ZΆ-ώ\s]+)"
ACCOUNT, CONTRACT, PARTNER, DOCUMENT = r"Α/Α\s+Λογαριασμού\s*(\d+)", r"Λογαριασμός\s+Συμβολαίου\s*(\d+)", r"Κωδικός\s+Εταίρου\s*(\d+.*?\d+)", r"Αρ\.\s+Παραστατικού\s*(\d+)"
READINGS, READINGS_TIGHT, READINGS_ENHANCED = r"(\d{5})\s+(\d{5})\s+(\d{3,4})", r"(\d{5})\s*(\d{5})\s*(\d{3,4})", r"(\d{5})\s+(\d{5})\s+(\d{4})"
DAYS, MULTIPLIER = r"ΗΜΕΡΑΣ\s+(\d+)", r"\d(?<!\d\d)(\d*+)\s++(1|40|80)\s++[\d,]"

#: What is dropped before blocks are searched, by profile.
NOISE = {"modern": (*HEADERS, *TOTALS, SUMMARY), "enhanced": (*HEADERS, "ΣΕΛΙΔΑ", *ENHANCED_TOTALS, SUMMARY)}
