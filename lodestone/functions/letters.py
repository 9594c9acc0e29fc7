"""Vietnamese letters with marks."""

from __future__ import annotations

import unicodedata

TONES = "̣̀́̃̉"
VOWELS = "aăâeêioôơuưy"
#: Lower-case Vietnamese letters with marks, made by rule, and their plain letters.
MARKED = "".join(unicodedata.normalize("NFC", v + t) for v in VOWELS for t in TONES) + "ăâêôơưđ"
PLAIN = "".join(unicodedata.normalize("NFD", c)[0].replace("đ", "d") for c in MARKED)
