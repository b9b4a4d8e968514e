"""How a citation's line is read: detectors of parts, and shapes that ask which parts are there and how they touch.

A line is taken apart by what it holds: a quotation with what stands before and behind it, a year or date and what it closes, a link, an imprint ("City:
Publisher") and a list of chapters peeled off its end. No expression spans a line, so that none tries its ways through it again and again.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

FIELDS = ("authors", "year", "yearend", "title", "container", "volume", "issue", "pages", "chapters", "sections", "publisher", "url", "report", "tail")

# Months as they are written, words before a number of chapters, sections or pages, labels of a set book.
MONTHS = "January February March April May June July August September October November December Jan Feb Mar Apr Jun Jul Aug Sept Sep Oct Nov Dec".split()
CHAPTERS, SECTIONS, PAGES, BOOKS = ("chapters", "chapter", "ch.", "ch"), ("sections", "section"), ("pages", "page", "pp.", "p.", "pp", "p"), ("textbook", "text", "book")
# Forms of a report's number and of pages.
REPORT = re.compile(r"[A-Z]{1,3}\d{4,6}|[A-Z]{2,4}-\d{2,6}|Report\s+\d+", re.I)
SPAN = r"[A-Za-z]?\d+\s*[-‐-―]\s*[A-Za-z]?\d+|[A-Za-z]{0,6}\d+"

YEAR = re.compile(r"(?<!\d)(?:1[89]|20)\d\d(?!\d)")
LINK = re.compile(r"https?://\S+", re.I)
NAME = re.compile(r"[A-Z][\w'’-]+")
NUMBERS = re.compile(r"\d[\d.,\s&-]*(?:and\s*[\d.]+)?")
IN = re.compile(r"\bin\s+", re.I)

Found = dict[str, str] | None


def after_word(t: str, words: tuple[str, ...]) -> str | None:
    """What follows one of the words at the start, the longest first."""
    low = t.lower()
    for w in sorted(words, key=len, reverse=True):
        if low.startswith(w):
            return t[len(w) :].lstrip()
    return None


def stopped(t: str) -> str:
    """Behind a comma or period."""
    return t[1:].lstrip() if t[:1] in (".", ",") else t


def ended(t: str) -> str:
    """Without the closing period."""
    t = t.rstrip()
    return t[:-1].rstrip() if t.endswith(".") else t


def until(t: str, signs: str) -> str:
    """Up to the first of the signs."""
    return t[: min((k for k in map(t.find, signs) if k >= 0), default=len(t))].strip()


@dataclass
class Quote:
    head: str
    title: str
    rest: str


def quotation(t: str) -> Quote | None:
    """An apostrophe within a word closes nothing."""
    start = min((k for k in map(t.find, "\"“‘") if k >= 0), default=-1)
    if start < 0:
        return None
    for k in range(start + 2, len(t)):
        if t[k] in "\"”" or t[k] == "’" and not t[k + 1 : k + 2].isalpha():
            title = t[start + 1 : k].strip()
            return Quote(t[:start].strip(), title, stopped(t[k + 1 :].lstrip())) if title else None
    return None


def month_before(t: str, day: bool) -> int | None:
    """Where the month begins that ends a text, with a day behind it if asked for (or allowed)."""
    words = t.rstrip(" ,").split(" ")
    for n in (2, 1) if not day else (2,):
        tail = words[-n:]
        if len(tail) == n and tail[0].title() in MONTHS and (n == 1 or tail[1].strip(",").isdigit() and len(tail[1].strip(",")) <= 2):
            return len(" ".join(words[:-n]))
    return None


def closed_by_date(head: str) -> tuple[str, str, bool] | None:
    """Authors, year and whether a day and month stand with it, where a year closes a head."""
    plain = ended(head)
    if not YEAR.fullmatch(plain[-4:]) or plain[-5:-4].isdigit():
        return None
    year, before = plain[-4:], plain[:-4].rstrip()
    at = month_before(before, True)
    authors = ended(before if at is None else before[:at])
    return (authors, year, at is not None) if authors and (at is not None or head.endswith(".")) else None


def parted_by_year(t: str, month: bool) -> tuple[str, str, str] | None:
    """Authors, year and the rest at the first year that a period follows, with its month if asked for."""
    for y in YEAR.finditer(t):
        behind, before = t[y.end() :], t[: y.start()]
        if not behind.startswith(".") or not before.endswith(" "):
            continue
        at = month_before(before, False) if month else len(before)
        if at is not None and ended(before[:at]):
            return ended(before[:at]), y[0], behind[1:].strip()
    return None


def chapters_off(t: str) -> tuple[str, str]:
    """A list of chapters taken off the end."""
    at = max(t.lower().rfind(" chapter"), 0)
    listed = after_word(t[at:].strip(), CHAPTERS[:2])
    return (t[:at].rstrip(" ,."), t[at:].strip()) if at and listed and re.fullmatch(r"\d[\d\s‐-―-]*", listed) else (t, "")


def peeled(t: str) -> tuple[str, str, str, bool]:
    """The main part, a list of chapters, a publisher, and whether a sign closed the line; the imprint's city is letters and spaces."""
    bare = t.rstrip().rstrip(".,").rstrip()
    closed = bare != t.rstrip()
    bare, listed = chapters_off(bare)
    city, colon, publisher = bare.rpartition(":")
    place = re.split("[.,]", city)[-1].strip() if colon else ""
    if not place or "." in publisher or not publisher.strip() or not all(c.isalpha() or c == " " for c in place) or len(place) == len(city.strip()):
        return bare, listed, "", closed
    main, inner = chapters_off(city.rstrip()[: -len(place)].rstrip(" .,"))
    return main, listed or inner, publisher.strip(" ,"), closed


def numbered(t: str) -> tuple[str, str, str, str] | None:
    """A name without digits, the volume behind it, an issue in brackets, pages behind a colon or comma."""
    at = re.search(r"\d+", t)
    if not at or not t[:1].isalpha():
        return None
    rest, issue = t[at.end() :].lstrip(), ""
    if rest.startswith("(") and ")" in rest:
        issue, rest = rest[1 : rest.index(")")], rest[rest.index(")") + 1 :].lstrip()
    pages = re.match(SPAN, rest[1:].lstrip()) if rest[:1] in (":", ",") and rest else None
    return t[: at.start()].rstrip(" ,"), at[0], issue, pages[0] if pages else ""


def people(t: str, number: bool = False) -> bool:
    """A list of capitalised names; with ``number`` each may bear one in brackets."""
    for name in re.split(r"\s*,\s*(?:and\s|&)?\s*|\s+and\s+|\s*&\s*", t.strip()):
        bare = re.sub(r"\s*\(\d{1,3}\)$", "", name) if number else name
        if not NAME.fullmatch(bare):
            return False
    return True


def of_quote(q: Quote) -> tuple[str, dict[str, str]] | None:
    """Shapes that a quotation with a dated head makes."""
    d = closed_by_date(q.head)
    if not d:
        return None
    led = {"authors": d[0], "year": d[1], "title": q.title}
    if d[2]:
        report, link = REPORT.match(q.rest), LINK.search(q.rest)
        place = until(stopped(q.rest[report.end() :].lstrip()), ",") if report else ""
        if place:
            return "dated_report_with_number", led | {"report": report[0], "container": place}
        paper = q.rest[: link.start()].rstrip() if link else ""
        if paper.endswith(":") and ":" not in paper[:-1] and paper[:-1].strip():
            return "dated_news_with_url", led | {"container": paper[:-1].strip(), "url": link[0]}
        return ("dated_agency_document", led | {"container": until(q.rest, ",")}) if until(q.rest, ",") else None
    if q.rest[:3].lower() == "in ":
        main, chapters, publisher, closed = peeled(q.rest[3:].strip())
        return ("author_date_chapter", led | {"container": main, "chapters": chapters, "publisher": publisher}) if main and (closed or publisher) else None
    n = numbered(q.rest)
    return ("author_date_journal", led | {"container": n[0], "volume": n[1], "issue": n[2], "pages": n[3]}) if n else None


def of_month(t: str) -> Found:
    """A report that a month and year head, its title and its house parted by a period."""
    d = parted_by_year(t, True)
    title, _, house = (d[2].rstrip(".,") if d else "").rpartition(".")
    good = 6 <= len(title) <= 140 and not re.search("[\"“]", title) and 4 <= len(house.strip()) <= 61 and house.strip()[0].isalpha()
    return {"authors": d[0], "year": d[1], "title": title, "container": house.strip()} if d and good else None


def of_rule(t: str) -> Found:
    """A part of the federal regulations, with its name before or behind it."""
    left, _, right = t.partition("::")
    name = re.sub(r"(?i)e?CFR\s*$", "", left)
    number = re.match(r"\d{1,2}\s+CFR\s+Part\s+\d{1,4}", right.strip(), re.I)
    return {"title": name.strip(), "report": number[0], "tail": right.strip()[number.end() :].lstrip(" -‐‑‒–—―")} if number and name != left else None


def of_year(t: str) -> tuple[str, dict[str, str]] | None:
    """Articles and books whose year follows the authors, without a quotation."""
    d = parted_by_year(t, False)
    if not d or not d[2]:
        return None
    led = {"authors": d[0], "year": d[1]}
    title, _, rest = d[2].partition(".")
    n = numbered(rest.lstrip())
    if n and 6 <= len(title) <= 140 and not re.search("[\"“]", title) and rest.lstrip()[0].isupper() and n[3]:
        return "author_date_unquoted_journal", led | {"title": title, "container": n[0], "volume": n[1], "issue": n[2], "pages": n[3]}
    main, chapters, publisher, _ = peeled(d[2])
    return ("author_date_book", led | {"title": main, "publisher": publisher, "chapters": chapters}) if publisher and main and not re.search("[\"“]", main) else None


def of_series(q: Quote) -> Found:
    """An entry of a site or series, the years behind its imprint."""
    span = re.search(r",\s*(\d{4})\s*[-‐-―]\s*(\d{4})?", q.rest)
    if not span or not q.rest.startswith("In ") or not q.head.endswith(".") or not q.head[:-1].strip():
        return None
    main, _, publisher, _ = peeled(q.rest[3 : span.start()])
    return {"authors": q.head[:-1], "title": q.title, "container": main, "publisher": publisher, "year": span[1], "yearend": span[2] or ""} if publisher else None


def of_site(q: Quote) -> Found:
    link, inside = LINK.search(q.rest), q.rest[3:].strip()
    if not link or q.rest[:3].lower() != "in " or not q.head.endswith(",") or not q.head[:-1].strip() or "," not in q.rest[: link.start()]:
        return None
    return {"authors": q.head[:-1], "title": q.title, "container": until(inside, ","), "url": link[0]}


def of_last_year(t: str) -> Found:
    """A book whose imprint ends in the year: authors, title, "City: Publisher, 2010"."""
    for y in YEAR.finditer(t):
        before, colon, publisher = t[: y.start()].rstrip().rpartition(":")
        if not colon or not publisher.endswith(",") or not 2 <= len(publisher.strip(" ,")) <= 60 or "," in publisher[:-1]:
            continue
        lead, _, place = before.rpartition(".")
        names, _, title = lead.strip().rpartition(".")
        if "), " in title:
            more, _, title = title.rpartition("), ")
            names = f"{names}.{more})"
        names = re.sub(r"\s*\(?\beds?\.?\)?\s*$", "", names).rstrip(" ,.(")
        places = [p.strip() for p in re.split("[;,]", place)]
        good = names and 6 <= len(title.strip()) <= 140 and all(re.fullmatch(r"[A-Za-z][A-Za-z .'-]{2,30}", p) for p in places) and len(places) <= 3
        if good:
            listed = re.search(r"[,.]\s*(chapters?\s+[\d\s,and-]+)", t[y.end() :], re.I)
            return {"authors": names, "title": title.strip(), "publisher": publisher.strip(" ,"), "year": y[0], "chapters": listed[1] if listed else ""}
    return None


def of_names(t: str) -> tuple[str, dict[str, str]] | None:
    """Names with a work that holds their chapters, or with chapters alone."""
    host, _, outer = ended(t).partition(" in ")
    if outer and outer[0].isupper() and 3 <= len(outer) <= 61 and people(host, True):
        return "chapter_in_container", {"authors": host, "container": outer}
    for space in re.finditer(r"[\s,]+", t):
        behind = t[space.end() :]
        rest = after_word(behind, (*CHAPTERS, *SECTIONS, "pages", "page", "pp.", "p."))
        count = NUMBERS.match(rest) if rest else None
        if count:
            who, over = t[: space.start()], ended(rest[count.end() :])
            names = re.split(r"\s+(?:and|&)\s+", who)
            if all(re.fullmatch(r"[A-Za-z][A-Za-z'’-]+", n) for n in names) and (not over or over.startswith(";") and 2 <= len(over[1:].strip()) <= 80 and ";" not in over[1:]):
                return "author_short_chapter", {"authors": who, "pages": behind[: len(behind) - len(rest) + count.end()].strip()}
            break
    return None


def of_locator(t: str) -> tuple[str, dict[str, str]] | None:
    """Lines that begin with chapters, sections or pages."""
    rest = after_word(t, (*CHAPTERS, *SECTIONS))
    if rest is not None:
        rest = after_word(rest, SECTIONS) or rest
        count = re.match(r"\d[\d.,\s-]*(?:\s*and\s*[\d.]+)?", rest)
        if count and len(rest) - count.end() <= 60:
            return "chapter_reference", {"pages": count[0].strip(), "title": rest[count.end() :].strip()}
        several = re.match(r"[\d.]+(?:\s*(?:and|,|&)\s*[\d.]+)*", rest)
        inner = re.split(r"\s*,?\s+in\s+", ended(rest[several.end() :]), maxsplit=1, flags=re.I) if several else []
        if len(inner) == 2 and inner[1]:
            return "numbered_sections_in_work", {"sections": several[0], "title": inner[0].strip(), "container": inner[1]}
    rest = after_word(t, PAGES)
    count = re.match(SPAN, rest) if rest else None
    outer = rest[count.end() :] if count else ""
    return ("page_range_in_work", {"pages": count[0], "container": ended(outer.lstrip()[3:].lstrip())}) if count and outer[:1] == " " and outer.lstrip()[:3].lower() == "in " and outer.lstrip()[3:].strip() else None


def of_book(t: str) -> tuple[str, dict[str, str]] | None:
    """A set book by its label, or by its title alone with chapters."""
    bare = ended(t)
    cut = re.split(r"\s*[;,:]\s*(?=ch)", bare, flags=re.I)
    listed = after_word(cut[-1], CHAPTERS) if len(cut) > 1 else None
    number = listed if listed and re.fullmatch(r"\d[\d\s,&-]*(?:and\s*\d+)?", listed) else None
    head = bare[: len(bare) - len(cut[-1])].rstrip(" ;,:") if number else ""
    title = after_word(bare, BOOKS)
    if title and title.startswith(":"):
        own = after_word(head, BOOKS)
        own = own[1:].strip() if own and own.startswith(":") else ""
        if number and 4 <= len(own) <= 90 and not re.search("[;,:]", own):
            return "named_book_chapter", {"title": own, "pages": number}
        whole = title[1:].strip()
        first, colon, second = whole.partition(":")
        if whole[:1].isalpha() and 7 <= len(first) <= 141 and (not colon or 2 <= len(second) <= 90 and ":" not in second):
            return "named_book", {"title": whole}
    words = head.split()
    if number and 1 <= len(words) <= 7 and head[0].isalpha() and all(re.fullmatch(r"[A-Za-z0-9'’&.-]+", w) for w in words):
        return "set_text_chapters", {"title": head, "pages": number}
    return None


def of_bracket(t: str) -> Found:
    """Authors, a year that may stand in brackets, a title and perhaps a publisher, parted by periods."""
    for y in YEAR.finditer(t):
        lead, behind = t[: y.start()].rstrip(" ("), t[y.end() :].lstrip(")")
        authors = lead[:-1].rstrip() if lead[-1:] in (".", ",") else ""
        title, period, rest = behind[1:].strip().partition(".")
        if behind.startswith(".") and authors[:1].isupper() and "." not in authors and 3 <= len(authors) <= 151 and period and 4 <= len(title) <= 170:
            house = re.match(r"[A-Z][^.]{2,90}", rest.lstrip())
            if len(rest.lstrip()) - (house.end() if house else 0) <= 82:
                return {"authors": authors, "year": y[0], "title": title, "publisher": house[0] if house else ""}
    return None


def of_chapter_title(t: str) -> Found:
    rest = after_word(t, CHAPTERS[:3])
    count = re.match(r"(\d{1,2})\s+", rest) if rest else None
    title = ended(rest[count.end() :]) if count else ""
    return {"pages": count[1], "title": title} if 7 <= len(title) <= 141 and title[0].isalpha() and "." not in title else None


def of_short_names(t: str) -> Found:
    """Names and a year in brackets, with chapters or a few words behind."""
    y = re.search(r"\(\s*((?:1[89]|20)\d\d)\s*\)", t)
    if not y:
        return None
    who, more = t[: y.start()].strip(), ended(t[y.end() :].strip())
    if not people(re.sub(r"(?:,\s*(?:and|&)?|\s+and|\s*&)?\s*\bet\s+al\.?\s*,?$", "", who)):
        return None
    where = re.match(r"[,.:;]?\s*([Cc]h(?:apters?|s?\.?)\s*[\d\s,&-]+)", more)
    left = more[where.end() :] if where else stopped(more)
    return {"authors": who, "year": y[1], "pages": where[1].strip() if where else ""} if len(left) <= 60 and "." not in left else None


def read(t: str) -> tuple[str, dict[str, str]] | None:
    """The name of the first shape that fits, and its fields."""
    q = quotation(t)
    dated = bool(YEAR.search(t))
    told = of_quote(q) if q and dated else None
    if told:
        return told
    for name, ask in (("dated_unquoted_report", dated and of_month), ("cfr_citation", "::" in t and of_rule)):
        if ask and (found := ask(t)):
            return name, found
    told = of_year(t) if dated else None
    if told and told[0] == "author_date_unquoted_journal":
        return told
    for name, ask in (("series_entry_open_ended", of_series), ("web_resource_in_site", of_site)):
        if q and (found := ask(q)):
            return name, found
    if dated and (found := of_last_year(t)):
        return "book_year_last", found
    told = told or of_names(t) or of_locator(t)
    if told:
        return told
    if q and len(q.head.rstrip(",. ")) <= 90:
        inner = q.rest[3:].strip() if q.rest[:3].lower() == "in " else q.rest
        return "quoted_title_loose", {"authors": q.head.rstrip(",. "), "title": q.title, "container": until(inner, ",.")[:70]}
    link = LINK.search(t)
    if link and link.start() and " " not in t[link.start() :]:
        return "titled_with_bare_url", {"title": t[: link.start()].rstrip(" :"), "url": link[0]}
    if told := of_book(t):
        return told
    if dated and (found := of_bracket(t)):
        return "author_date_book", found
    for name, ask in (("chapter_with_title", of_chapter_title), ("author_year_short", dated and of_short_names)):
        if ask and (found := ask(t)):
            return name, found
    sides = [s.strip() for s in t.split("|")]
    return ("page_title_with_site", {"title": sides[0], "container": sides[1]}) if len(sides) == 2 and 4 <= len(sides[0]) <= 110 and 2 <= len(sides[1]) <= 60 else None
