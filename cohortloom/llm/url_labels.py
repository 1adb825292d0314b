"""The small labelled url table: invented site names, each with several hosts and paths.

Subdomains, top-level domains and paths are dealt to both labels alike, so only names tell.
"""

from __future__ import annotations

# fixed values
BLOCKED_CORES = """
pills meds pharma viagra casino slots jackpot poker lotto bets betting spins gift prize adult xxx sex cams porn
dating spam seo links ads track click popup banner loans payday cash money crypto replica diet crack
""".split()
MODIFIERS = "cheap best free win online hot quick farm server".split()

WANTED_CORES = """
library news garden weather university museum maps docs recipes history herald math parliament trains cycling
astronomy school poetry woodwork chess ledger geology theatre birds trails village law music hospital orchestra
""".split()
PLACES = "city north harbour old river open spring local hill".split()
SYLLABLES = "th er on an re in ed at en es or nt ti st ou ar ver keit ung ment elle tion ci que ado".split()

SUBDOMAINS = ("", "www.", "m.", "blog.")
DOMAINS = ("example.com", "example.org", "example.net")
PATHS = ("/en/12", "/de/77?page=2", "/fr/199?utm_source=feed", "/es/431/", "/en/88.html", "/", "/fr/5#top")


def blocked_names() -> list[str]:
    """Every core word with four modifiers, before or after it."""
    names = []
    for i, core in enumerate(BLOCKED_CORES):
        for k in range(4):
            other = MODIFIERS[(i + 2 * k) % len(MODIFIERS)]
            names.append(f"{core}-{other}" if k % 2 else f"{other}-{core}")
    return names


def wanted_names() -> list[str]:
    """Core words with two places each, and made-up names of three syllables."""
    names = []
    for i, core in enumerate(WANTED_CORES):
        for k in range(2):
            other = PLACES[(i + 2 * k) % len(PLACES)]
            names.append(f"{core}-{other}" if k % 2 else f"{other}-{core}")
    n = len(SYLLABLES)
    return names + [
        SYLLABLES[i % n] + SYLLABLES[(3 * i + i // n + 1) % n] + SYLLABLES[(7 * i + 2) % n] for i in range(80)
    ]


def labelled() -> list[tuple[str, float]]:
    """(url, label): 1 for urls to block."""
    rows = []
    for label, names in ((1.0, blocked_names()), (0.0, wanted_names())):
        for i, name in enumerate(names):
            for j, sub in enumerate(SUBDOMAINS):
                domain, path = DOMAINS[(i + j) % len(DOMAINS)], PATHS[(i + 3 * j) % len(PATHS)]
                rows.append((f"https://{sub}{name}.{domain}{path}", label))
    return rows
