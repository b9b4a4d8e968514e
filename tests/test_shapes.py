"""Shapes of citations, read from lines that are already squeezed and have plain dashes."""

import pytest

from folium.functions.shapes import peeled, quotation, read

CASES = [
    ("NRC Ch 1", "author_short_chapter", {"authors": "NRC", "pages": "Ch 1"}),
    ("Adeyemi and Osei, Chapter 1", "author_short_chapter", {"authors": "Adeyemi and Osei", "pages": "Chapter 1"}),
    ("Berg in Comparative Rule.", "chapter_in_container", {"authors": "Berg", "container": "Comparative Rule"}),
    ("Lind (15) and Osei (14) in Comparative Rule.", "chapter_in_container", {"authors": "Lind (15) and Osei (14)"}),
    ("Levin, Steve, and Dan Zib. (2018). How Rules Die. Crown.", "author_date_book", {"year": "2018", "title": "How Rules Die", "publisher": "Crown"}),
    ("Main, Scott, and Frances Hago, eds. 2005. The Third Tide. Camford Press.", "author_date_book", {"year": "2005", "title": "The Third Tide"}),
    ("Chapter 3 Earnings and Income: The blocks", "chapter_reference", {"pages": "3"}),
    ("Book: Hazard Analysis: Chapter 2", "named_book_chapter", {"title": "Hazard Analysis", "pages": "2"}),
    ("Gore (2020), Ch. 2-3", "author_year_short", {"authors": "Gore", "pages": "Ch. 2-3"}),
    ("Smith et al. (2011)", "author_year_short", {"year": "2011"}),
    ("Doe, Jane. 2007. “Women’s rights and more.” World Papers 59 (4): 513-546.", "author_date_journal", {"title": "Women’s rights and more.", "container": "World Papers", "volume": "59", "issue": "4", "pages": "513-546"}),
    ("Doe, Jane and John Roe. 2012. “Title here.” In Big Handbook, Chapters 3-4. Oxford: Oxford Press.", "author_date_chapter", {"container": "Big Handbook", "chapters": "Chapters 3-4", "publisher": "Oxford Press"}),
    ("Walt, Ken. 1979. Theory of Things. New York: Hill, chapters 1-4.", "author_date_book", {"title": "Theory of Things", "publisher": "Hill", "chapters": "chapters 1-4"}),
    ("pp. 12-40 in Arms and Influence", "page_range_in_work", {"pages": "12-40", "container": "Arms and Influence"}),
]
NONE = ["Discussed in class", "We will meet on Tuesday. Bring your notes. Thanks.", "Attendance: students are expected to attend every class meeting", "Week 3: Reading the landscape", "The committee met (2016) and decided", "", "2010", "“”", "((((", "…" * 500]


@pytest.mark.parametrize("line,name,want", CASES)
def test_shapes(line, name, want):
    got = read(line)
    assert got and got[0] == name
    assert {k: got[1][k] for k in want} == want


@pytest.mark.parametrize("line", NONE)
def test_what_is_no_citation(line):
    assert read(line) is None


def test_parts():
    assert quotation("Doe, “What’s new?” In X").title == "What’s new?"
    assert quotation("no “closing sign") is None and quotation("none at all") is None
    assert peeled("The Whole Thing, Boston: Press.") == ("The Whole Thing", "", "Press", True)
    assert peeled("A thing without an imprint") == ("A thing without an imprint", "", "", False)


def test_long_lines_take_no_time():
    import time

    began = time.time()
    for line in ("A. " * 5000 + "2010. x", "“" + "a, b. " * 5000, "Doe 2001. " * 3000, "in " * 10_000, "(2010) " * 3000):
        read(line)
    assert time.time() - began < 5
