"""A small labelled URL table: invented sites of the kinds that URL filters keep out, and ordinary ones.

A site's name is a telling word beside a word that both kinds use, before or behind it. Both kinds have the same
subdomains, endings and pages, so only the telling words differ.
"""

from __future__ import annotations

#: Gambling, pills, adult pages, trackers, link farms, counterfeit shops, fraud.
BLOCK = """
casino slots jackpot poker roulette bets betting gamble lottery bingo
pills meds viagra cialis steroids slimming
adult porn xxx sexy cams escorts nude
ads adserver track tracker clicks popup banner pixel
spam farm linkfarm seo backlinks clickbait
replica knockoff fake outlet prize winner giveaway cashnow payday crypto-doubler crack warez torrents keygen
"""

#: News, schools, shops, weblogs, forums, libraries, public offices, clubs.
ALLOW = """
library university news times weather recipes museum gallery science software
school forum trains bank hospital health council parliament music football
theatre books ceramics bakery hotel maps wiki antiques toys walks
archive station brother handmade northern theory thrift mother leather engineering
anthem physics garden market church photo animals chess choir river
sailing weaving
"""

#: Words of both kinds of sites.
COMMON = "online free best my shop the top win live now daily club new world cheap big".split()
SUBDOMAINS = ("", "www.", "m.", "blog.")
ENDS = ("com", "net", "org")
PAGES = ("/", "/en/{}", "/de/{}.html", "/fr/{}/", "/es/{}", "/en/{}.html", "/de/{}/", "/fr/{}", "/es/{}.html", "/about", "/news/{}")


def labelled(block: int = 3, allow: int = 7) -> list[tuple[str, int]]:
    """(url, 1 to keep out, 0 to let pass), so many sites for each telling word; most sites are ordinary ones."""
    rows = []
    for label, words, sites in ((1, BLOCK.split(), block), (0, ALLOW.split(), allow)):
        for k, word in enumerate(words):
            for n in range(sites * k, sites * k + sites):
                other = COMMON[n * 5 % len(COMMON)]
                name = f"{word}-{other}" if n % 2 else f"{other}-{word}"
                page = PAGES[n % len(PAGES)].format(37 * n % 1000)
                rows.append((f"https://{SUBDOMAINS[n // 3 % 4]}{name}.{ENDS[n % 3]}{page}", label))
    return rows
