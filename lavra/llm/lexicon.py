"""Common words of Portuguese, English and Spanish, and a language vote over them."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

from lavra.functions import codepoints as cp

# Frequent function words, folded (lower case, no accents).
COMMON = {
    "pt": (
        "a ao aos aquela aquele aqui as ate cada com como contra da das de dela dele depois desde do dos durante e ela elas ele eles em "
        "embora entao entre era essa esse esta estao estar este eu foi foram ha isso isto ja la lhe mais mas mesmo meu muito muitos na nao nas "
        "nem no nos nossa nosso num numa o onde os ou para pela pelas pelo pelos pode por porem porque qual quando que quem sao se segundo sem "
        "ser seu sob sobre sua suas seus tambem te tem tenho ter todo todos tudo um uma voce vos"
    ).split(),
    "en": (
        "a about according after all also although an and any are as at be because been before between but by can could did do does during each "
        "for from had has have he her his how if in into is it its many may more most much must my no not of on one only or other our out over "
        "quite rather she should since so some such than that the their them then there these they this through to too up was we were what when "
        "where which while who whoever will with within without would you your"
    ).split(),
    "es": (
        "a al algo algun alguna ante antes aqui asi aunque cada como con contra cual cuando de debe del desde despues donde durante e el ella "
        "ellas ellos en entonces entre era es esa ese eso esta estaba estar este esto fue ha hace hacia hasta hay la las le les lo los mas me "
        "mientras mi mismo mucho muchos muy nada ni no nos nosotros o os otra otro para pero por porque que quien se sea segun ser si sido sin "
        "sobre son su sus tambien tan tanto te tiene todo todos tras un una unas uno unos y ya yo"
    ).split(),
}
LANGUAGES = tuple(COMMON)


@lru_cache(maxsize=1)
def _table() -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of all common words, and per word a vote for each language, shared among those that have it."""
    votes: dict[str, list[float]] = {}
    for k, lang in enumerate(LANGUAGES):
        for w in set(COMMON[lang]):
            votes.setdefault(w, [0.0] * len(LANGUAGES))[k] = 1.0
    text = sorted(votes)
    codes, bounds = cp.decode(pa.array(text, pa.large_string()))
    h = cp.span_hashes(cp.prefix_hash(codes), bounds[:-1], bounds[1:])
    v = np.array([votes[w] for w in text])
    v /= v.sum(axis=1, keepdims=True) ** 2
    order = np.argsort(h)
    return h[order], v[order]


def lookup(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which words are common, and the row of the vote table of each common one."""
    known, _ = _table()
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    return known[at] == hashes, at


def language_votes(hashes: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Votes by row and language."""
    hit, at = lookup(hashes)
    votes = _table()[1][at[hit]]
    return np.stack([np.bincount(row[hit], weights=votes[:, k], minlength=rows) for k in range(len(LANGUAGES))], axis=1)


def languages(hashes: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Language of each row by most votes, ties to the first listed; "und" without any vote."""
    votes = language_votes(hashes, row, rows)
    names = np.array([*LANGUAGES, "und"], object)
    return names[np.where(votes.max(axis=1) > 0, votes.argmax(axis=1), len(LANGUAGES))]
