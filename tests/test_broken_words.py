"""Patterns of broken words run only in texts that hold the broken word, and miss none of them."""

import re

from foliant.functions import lexicon as lex

WHOLE = "gmbh für über ändern geprüft geschäfts jahresabschluss grundstücke verhältnissen ordnungsgemäß buchführung gemeinsam vermögens finanzübersicht gebühren geben empfänger beträge straße maßnahme strasse gebiet"


def test_whole_words_start_no_pattern():
    assert [p for p, literal in lex.BROKEN_WORDS if literal in WHOLE] == []


def test_literals_stand_in_all_matches():
    for p, literal in lex.BROKEN_WORDS:
        for gap in (" ", "\n", " \n\n "):
            text = ("x" if r"\w?" in p else "") + re.sub(r"\\b|\\w\?", "", p).replace("[aA]", "A").replace(r"\s+\s", "\0\0").replace(r"\s+", "\0").replace("\0", gap)
            assert re.search(p, text, re.I) and literal in re.sub(r"\s+", " ", text).lower(), p
