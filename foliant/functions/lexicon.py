"""Fixed values of text-quality scoring: word lists, patterns, weights and lookups.

Patterns are kept in the form both regex engines read; ``for_java`` and ``for_re2`` make the two spellings.
"""

from __future__ import annotations

# Common German words.
GERMAN_WORDS = """
der die das den dem des ein eine einer eines und oder aber nicht auch nur noch schon sehr für über unter 
zwischen durch gegen ohne während werden wurde wird sind ist hat haben kann nach vom zum zur bei mit auf aus 
von würde können müssen größe größer größte größten fähig tätig mäßig gemäß ungefähr dafür 
darüber hierfür wofür außer außerdem ähnlich öffentlich möglich nötig höher höchst prüfung 
geprüft erfüllt erläutert erklären entspricht geschäftsjahr jahresabschluss gesellschaft vermögens 
finanzlage ertragslage maßnahme maßgeblich straße bilanz gewinn verlust rechnung anhang lagebericht 
kontoauszug kontostand buchungsdatum wertstellung valuta umsatz betrag saldo soll gutschrift lastschrift 
verwendungszweck empfänger auftraggeber zahlungseingang überweisung dauerauftrag abbuchung einzahlung 
auszahlung bankleitzahl kontonummer kreditkarte girokonto abrechnung kartenabrechnung kreditkartenabrechnung 
buchungstext buchung transaktion transaktionsdatum zinsen gebühren entgelt provision kontoinhaber 
bankverbindung zahlungsverkehr rechnungsnummer rechnungsdatum fälligkeitsdatum steuernummer umsatzsteuer 
mehrwertsteuer nettobetrag bruttobetrag gesamtbetrag zwischensumme einzelpreis menge lieferdatum 
bestellnummer kundennummer anschrift telefon datum seite blatt euro

""".split()

# Common English words.
ENGLISH_WORDS = """
the and that have for not with you this but his from they were been their would there which about when will 
more some than them other into could your time very just know take come financial statement report company 
business annual balance sheet income audit auditor opinion account transaction payment transfer amount total 
invoice credit debit date number reference bank customer order price quantity description

""".split()

# Counts of these lower the umlaut score; the last three exclude some followers.
WRONG_UMLAUTS = [("[a-z]ii[a-z]", ""), ("ae", "[rl]"), ("oe", "[uv]"), ("ue", "[lrst]")]
UMLAUTS = "[äöüÄÖÜß]"

# Signs of recognition errors. \b is ASCII; the last class is everything but blanks, letters,
# digits, the underscore and the marks listed.
ERROR_PATTERNS = [
    "(?i)[a-z]ii[a-z]",
    "(?i)[a-z]fl[a-z]",
    "(?i)[a-z]fi[a-z]",
    r"\b[A-Z]{5,}\b",
    r"""[^\s\p{Z}\p{L}\p{N}_.,;:\-()\[\]"'/&%€$§!?@#+=*]""",
]

# Words that lost a letter, all without regard to ASCII case. Beside each, what its
# matches always hold in lower case with each run of blanks as one space.
BROKEN_WORDS = [
    (r"G\s+bH", "g bh"),
    (r"\bf\s+r\b", "f r"),
    (r"\b\w?\s+ber\b", " ber"),
    (r"\b[aA]\s+ndern", "a ndern"),
    (r"gepr\s+ft", "gepr ft"),
    (r"Gesch\s+fts", "gesch fts"),
    (r"Jahresabschl\s+ss", "jahresabschl ss"),
    (r"Grunds\s+tze", "grunds tze"),
    (r"Verh\s+ltnissen", "verh ltnissen"),
    (r"tats\s+chlichen", "tats chlichen"),
    (r"ordnungsm\s+ig", "ordnungsm ig"),
    (r"Buchf\s+hrung", "buchf hrung"),
    (r"Erl\s+uterungen", "erl uterungen"),
    (r"zuk\s+nftigen", "zuk nftigen"),
    (r"einschlie\s+lich", "einschlie lich"),
    (r"gem\s+\s", "gem "),
    (r"ma\s+geblich", "ma geblich"),
    (r"verf\s+gbar", "verf gbar"),
    (r"Verm\s+gens", "verm gens"),
    (r"Finanz\s+bersicht", "finanz bersicht"),
    (r"\bUberweisung", "uberweisung"),
    (r"\bUbersicht", "ubersicht"),
    (r"\bUber\b", "uber"),
    (r"\b0ffentlich", "0ffentlich"),
    (r"Geb\s+hren", "geb hren"),
    (r"Kontoaus\s+ge", "kontoaus ge"),
    (r"Empf\s+nger", "empf nger"),
    (r"Beg\s+nstigter", "beg nstigter"),
    (r"Auftr\s+ge", "auftr ge"),
    (r"Betr\s+ge", "betr ge"),
    (r"R\s+ckbuchung", "r ckbuchung"),
    (r"Geb\s+hr", "geb hr"),
    (r"Stra\s+e\b", "stra e"),
    (r"Ma\s+nahme", "ma nahme"),
]

# Weights of the word, umlaut, character, length and missing-character scores.
WEIGHTS = (0.35, 0.25, 0.15, 0.10, 0.15)
SEVERE, THRESHOLD, LANGUAGE = 30.0, 60.0, "deu+eng"

# Document languages as recognition codes.
LANGUAGE_CODES = {
    "de": "deu", "deu": "deu", "ger": "deu", "german": "deu", "deutsch": "deu",
    "en": "eng", "eng": "eng", "english": "eng",
    "fr": "fra", "fra": "fra", "fre": "fra", "french": "fra",
    "es": "spa", "spa": "spa", "spanish": "spa",
    "it": "ita", "ita": "ita", "italian": "ita",
    "nl": "nld", "nld": "nld", "dut": "nld", "dutch": "nld",
    "pt": "por", "por": "por", "portuguese": "por",
    "pl": "pol", "pol": "pol", "polish": "pol",
    "ru": "rus", "rus": "rus", "russian": "rus",
    "tr": "tur", "tur": "tur", "turkish": "tur",
}

ASCII_BOUNDARY = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"


def for_java(pattern: str) -> str:
    """Java's \\b takes other letters for word characters, so ASCII boundaries are written out.

    At the start before a word character, and at the end after one, one look to the side is enough.
    """
    flags, body = (pattern[:4], pattern[4:]) if pattern.startswith("(?i)") else ("", pattern)
    if body.startswith(r"\b") and not body.startswith(r"\b\w?"):
        body = "(?<![A-Za-z0-9_])" + body[2:]
    if body.endswith(r"\b"):
        body = body[:-2] + "(?![A-Za-z0-9_])"
    return flags + body.replace(r"\b", ASCII_BOUNDARY)


def for_re2(pattern: str) -> str:
    return pattern
