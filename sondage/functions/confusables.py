"""Letters that look alike across scripts, after the public Unicode data on confusables, as classes of letters.

A class is named by its Latin member. The letters drawn alike are stated script by script; presentation forms, small
capitals and letters with a case partner follow by rule, so the tables stay short.
"""

from __future__ import annotations

import unicodedata

# A Latin letter and the letter of the script that is drawn the same way.
CYRILLIC = "aа cс dԁ eе hһ iі jј lӏ oо pр qԛ sѕ vѵ wԝ xх yу AА BВ CС EЕ GԌ HН IІ JЈ KК MМ OО PР QԚ SЅ TТ VѴ WԜ XХ YУ"
GREEK = "aα cϲ iι jϳ oο pρ uυ vν yγ AΑ BΒ CϹ EΕ FϜ HΗ IΙ JͿ KΚ MΜ NΝ OΟ PΡ TΤ XΧ YΥ ZΖ"
ARMENIAN = "gց hհ jյ nո oօ qզ uս LԼ OՕ SՏ UՍ"
CHEROKEE = "AᎪ BᏴ CᏟ DᎠ EᎬ GᏀ HᎻ JᎫ KᏦ LᏞ MᎷ PᏢ RᏒ SᏚ TᎢ VᏙ WᎳ YᎩ ZᏃ"
COPTIC = "cⲥ oⲟ pⲣ AⲀ BⲂ CⲤ HⲎ IⲒ KⲔ MⲘ NⲚ OⲞ PⲢ TⲦ XⲬ YⲨ ZⲌ"
LISU = "AꓮBꓐCꓚDꓓEꓰFꓝGꓖHꓧIꓲJꓙKꓗLꓡMꓟNꓠOꓳPꓑRꓣSꓢTꓔUꓴVꓦWꓪXꓫYꓬZꓜ"
# Further letters of a class whose script has a plainer member; in text of their own script they stay.
FURTHER = "iꭵ yү GᏳ IӀ RᎡ WᏔ YҮ bᏏ hᏂ"
# Other shapes of a letter or sign within its script, and the plain one.
WITHIN = {"ɑ": "a", "ɡ": "g", "ı": "i", "ɩ": "i", "ℓ": "l", "‐": "-", "‑": "-", "⁃": "-", "−": "-", "ꞌ": "'", "ʼ": "’", "ǃ": "!"}
#: Letters whose capital is only a larger form of the small one, so that small capitals look like small letters.
SAME_SHAPE = "CISOUVWXZ"

SCRIPTS = {"Cyrillic": CYRILLIC.split(), "Greek": GREEK.split(), "Armenian": ARMENIAN.split(), "Cherokee": CHEROKEE.split(), "Coptic": COPTIC.split(), "Lisu": [LISU[i : i + 2] for i in range(0, len(LISU), 2)]}

#: letter -> class (its Latin member); class -> {script: plainest member}
CLASS: dict[str, str] = {}
MEMBER: dict[str, dict[str, str]] = {}
for _script, _pairs in SCRIPTS.items():
    if _script == "Cherokee":  # its small letters are small capitals
        _pairs = _pairs + [p[0].lower() + p[1].lower() for p in _pairs if p[0] in SAME_SHAPE]
    for _latin, _other in _pairs:
        CLASS[_latin], CLASS[_other] = _latin, _latin
        MEMBER.setdefault(_latin, {"Latin": _latin})[_script] = _other
for _latin, _other in FURTHER.split():
    CLASS[_latin], CLASS[_other] = _latin, _latin
    MEMBER.setdefault(_latin, {"Latin": _latin}).setdefault(unicodedata.name(_other).split()[0].capitalize(), _other)


def _small_capitals() -> dict[str, str]:
    names = {ch: f"LATIN LETTER SMALL CAPITAL {ch}" for ch in SAME_SHAPE}
    known = {unicodedata.name(chr(c), ""): chr(c) for a, b in ((0x250, 0x2B0), (0x1D00, 0x1D2C), (0xA730, 0xA732)) for c in range(a, b)}
    return {known[name]: ch.lower() for ch, name in names.items() if name in known}


VARIANT: dict[str, str] = WITHIN | _small_capitals()
#: Every letter of another script that has a class, and its Latin member, for str.translate.
TO_LATIN: dict[int, str] = {ord(ch): latin for ch, latin in CLASS.items() if ch != latin} | {ord(ch): to for ch, to in VARIANT.items()}


def _by_case() -> dict[int, str]:
    """Small letters to the small Latin letter that they, or else their capitals, look like."""
    out = {}
    for ch, latin in CLASS.items():
        low = ch.lower()
        if len(low) == 1 and (ch == low or low not in CLASS):
            out.setdefault(ord(low), latin.lower())
    return out


#: For text in small letters: look-alikes as they are or as capitals, so that letter case makes no difference.
FOLDED: dict[int, str] = _by_case()
