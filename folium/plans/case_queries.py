"""Scalar functions and parsers over written cases: each row of a table is given the case that its key picks, with the key in it.

The cases say what the functions' rules say, one by one: that is their SQL, too.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from folium.functions import cite as C
from folium.functions import dates as D
from folium.functions import text as T
from folium.operators import frontmatter as M
from folium.operators import graded as W
from folium.operators import grades as A
from folium.operators import layout as L
from folium.operators import policies as P
from folium.operators import publish as X
from folium.operators import rescue as R
from folium.operators import schedule as S
from folium.operators import segment as G
from folium.registry import cases

TEXT, INT, LONG, REAL, DATE, BOOL = "VARCHAR", "INTEGER", "BIGINT", "DOUBLE", "DATE", "BOOLEAN"


def term(name: str, year: int):
    return F.struct(F.lit(name).alias("name"), F.lit(year).alias("year"))


# ---- text

cases("cid_glyphs", [("a(cid:3)b{k}", "a b{k}"), ("(cid:12) Week {k}", " Week {k}"), ("end {k}(cid:7)", "end {k}"), ("x (cid:1)(cid:2) y{k}", "x  y{k}"), ("no glyph {k}", "no glyph {k}")], lambda x: {"text": T.strip_cid_glyphs(x)}, "TXT1.", {"text": TEXT})
cases(
    "control_glyphs",
    [("di\x1berent {k}", "different {k}"), ("\x0cnd {k}", "find {k}"), ("o\x0ece {k}", "office {k}"), ("\x10quoted\x11 {k}", "“quoted” {k}"), ("it\x13s {k}", "it’s {k}"), ("pages 1{k}\x149", "pages 1{k}-9"), ("\x15 item {k}", "  item {k}"), ("a\x1cb{k}", "a b{k}"), ("\x0bort {k}", "ffort {k}")],
    lambda x: {"text": T.decode_control_glyphs(x)}, "TXT2.", {"text": TEXT},
)
cases(
    "diacritics",
    [("Zolt´an {k}", "Zoltán {k}"), ("citt`a {k}", "città {k}"), ("`new {k}'", "`new {k}'"), ("L´opez {k}", "López {k}"), ("don´t {k}", "don´t {k}"), ("nin~o {k}", "ninõ {k}"), ("garc¸on {k}", "garçon {k}"), ("~ {k}", "~ {k}"), ("M¨uller {k}", "Müller {k}"), ("x^2 {k}", "x^2 {k}")],
    lambda x: {"text": T.compose_diacritics(x)}, "TXT3.", {"text": TEXT},
)
cases("ligatures", [("eﬃcient {k}", "efficient {k}"), ("œuvre {k}", "oeuvre {k}"), ("Æsop {k}", "AEsop {k}"), ("ﬁnd ﬂow {k}", "find flow {k}"), ("ﬅop {k}", "stop {k}"), ("plain {k}", "plain {k}")], lambda x: {"text": T.expand_ligatures(x)}, "TXT4.", {"text": TEXT})
cases("unicode_spaces", [("a b{k}", "a b{k}"), ("a​b{k}", "ab{k}"), ("é {k}", "é {k}"), ("so­ft {k}", "soft {k}"), ("thin gap {k}", "thin gap {k}"), ("﻿start {k}", "start {k}")], lambda x: {"text": T.normalize_unicode(x)}, "TXT5.", {"text": TEXT})
cases("parsing_dashes", [("pp. 12 – 1{k}", "pp. 12-1{k}"), ("co—op {k}", "co-op {k}"), ("a – b {k}", "a – b {k}"), ("3−4 {k}", "3-4 {k}"), ("x‑y {k}", "x-y {k}")], lambda x: {"text": T.fold_dashes(x)}, "TXT6.", {"text": TEXT})
cases(
    "wrapped_urls",
    [("see https://a.org/x-\ny/z{k}.html now", "see https://a.org/x-y/z{k}.html now"), ("https://a.org/x{k}\nChapter two", "https://a.org/x{k}\nChapter two"), ("https://a.org/x{k}/\nChapter", "https://a.org/x{k}/Chapter"), ("www.b.org/a{k}\nbook: next", "www.b.org/a{k}\nbook: next"), ("https://c.org/a\nb\nc{k}", "https://c.org/abc{k}"), ("plain\ntext {k}", "plain\ntext {k}")],
    lambda x: {"text": T.rejoin_wrapped_urls(x)}, "TXT7.", {"text": TEXT},
)
cases(
    "url_gaps",
    [("https://a.org/one two/three{k}", "https://a.org/one-two/three{k}"), ("https://a.org/x{k} and more", "https://a.org/x{k} and more"), ("https://a.org/x. page/{k}", "https://a.org/x. page/{k}"), ("www.a.org/some more-slug-{k}", "www.a.org/some-more-slug-{k}"), ("some text/{k} more", "some text/{k} more")],
    lambda x: {"text": T.close_url_spaces(x)}, "TXT8.", {"text": TEXT},
)
cases("hyphens", [("infor-\nmation {k}", "information {k}"), ("Anglo-\nSaxon {k}", "Anglo-Saxon {k}"), ("well-\nknown {k}", "well-known {k}"), ("a - \n b{k}", "a - \n b{k}"), ("end-  \n  less {k}", "endless {k}")], lambda x: {"text": T.dehyphenate(x, ("well-known",))}, "TXT9.", {"text": TEXT})
cases(
    "spaced_marks",
    [("one,two {k}", "one, two {k}"), ("1,000 {k}", "1,000 {k}"), ("R.,and {k}", "R., and {k}"), ("ended.Then {k}", "ended. Then {k}"), ("R.Smith {k}", "R.Smith {k}"), ("see https://a.org/x,y/z{k} and a,b", "see https://a.org/x,y/z{k} and a, b"), ("e.g.Foo {k}", "e.g.Foo {k}")],
    lambda x: {"text": T.space_after_punctuation(x)}, "TXT10.", {"text": TEXT},
)
cases(
    "camel_split",
    [("readingList{k} x", "reading List{k} x"), ("McDonald {k}", "McDonald {k}"), ("PhD {k}", "PhD {k}"), ("eLC {k}", "eLC {k}"), ("vanGogh {k}", "vanGogh {k}"), ("HallBlouinStarr {k}", "Hall Blouin Starr {k}"), ("at https://x.org/fooBar{k}", "at https://x.org/fooBar{k}"), ("iPhone {k}", "iPhone {k}")],
    lambda x: {"text": T.restore_spaces(x)}, "TXT11, TXT12 without a lexicon.", {"text": TEXT},
)
cases(
    "markers",
    [("• item {k}", "item {k}", "•"), ("(cid:117) Week {k}", "Week {k}", "(cid:117)"), ("u Week {k}", "Week {k}", "u"), ("- dash {k}", "dash {k}", "-"), ("word {k}", "word {k}", None), ("? odd {k}", "odd {k}", "?"), ("* star {k}", "star {k}", "*"), ("*tight {k}", "*tight {k}", None)],
    lambda x: {"line": T.strip_leading_marker(x)["line"], "marker": T.strip_leading_marker(x)["marker"]}, "TXT14.", {"line": TEXT, "marker": TEXT},
)
cases("dois", [("doi:10.1234/ab.{k}).", "10.1234/ab.{k}"), ("https://doi.org/10.55555/x-{k};", "10.55555/x-{k}"), ("none {k}", None)], lambda x: {"doi": T.first_doi(x)}, "TXT17.", {"doi": TEXT})
cases("file_words", [("Smith - 2006 - The_Title{k}.pdf", "Smith 2006 The Title{k}"), ("a-b(c)[d]{k}.PDF", "a b c d {k}"), ("plain {k}", "plain {k}")], lambda x: {"words": T.filename_words(x)}, "TXT19.", {"words": TEXT})
cases(
    "stop_words", [("The art of war and peace {k}xx", "art peace war {k}xx"), ("How its why with {k}yy", "how its why with {k}yy"), ("is as it an {k}zz", "{k}zz")],
    lambda x: {"words": F.array_join(F.filter(F.concat(F.array_sort(F.filter(T.tokens(x), lambda w: ~w.rlike("^[0-9]"))), F.filter(T.tokens(x), lambda w: w.rlike("^[0-9]"))), lambda w: w != ""), " ")}, "TXT20's list for matches.", {"words": TEXT},
)
cases("lookup_words", [("The art of war and peace {k}xx", "art peace war {k}xx"), ("How its why with {k}yy", "{k}yy"), ("from their books {k}zz", "books {k}zz")], lambda x: {"words": F.array_join(F.concat(F.array_sort(F.filter(R.words(x), lambda w: ~w.rlike("^[0-9]"))), F.filter(R.words(x), lambda w: w.rlike("^[0-9]"))), " ")}, "TXT20's list for look-ups.", {"words": TEXT})

# ---- dates and numbers

cases(
    "found_terms",
    [("Syllabus {k}, Fall 2030", "fall", 2030), ("2031 Winter {k}", "winter", 2031), ("Spring/Summer 2016 {k}", None, None), ("spring 2029 and fall 2030 {k}", "spring", 2029), ("Autumn 2030 {k}", None, None), ("Fall, 2030 {k}", None, None), ("no term {k}", None, None)],
    lambda x: {"name": D.find_term(x)["name"], "year": D.find_term(x)["year"]}, "DAT1.", {"name": TEXT, "year": INT},
)
cases(
    "dates_in_text",
    [("{k}: Jan. 9, 2/14 and March 3rd", "2031-01-09 2031-02-14 2031-03-03"), ("{k}: Dec 5", "2030-12-05"), ("{k}: Feb 30 or 4/5/29", "2029-04-05"), ("{k}: August 2020", ""), ("{k}: Aug13-15", "2031-08-13"), ("{k}: February, 5", "2031-02-05"), ("nothing here {k}", ""), ("{k}: sept 1st; 13/40", "2031-09-01")],
    lambda x: {"dates": F.array_join(F.transform(D.iter_dates(x, term("winter", 2031)), lambda d: d.cast("string")), " ")}, "DAT3, DAT4.", {"dates": TEXT},
)
cases(
    "clock_times",
    [("{k} due at midnight", "23:59:00"), ("{k} by noon", "12:00:00"), ("{k} at 9.05 a.m.", "09:05:00"), ("{k}, 5pm", "17:00:00"), ("{k}, 12:30 pm", "12:30:00"), ("{k}, 12 am", "00:00:00"), ("{k}, 13:61 pm", None), ("{k} later", None)],
    lambda x: {"clock": D.parse_time(x)}, "DAT5.", {"clock": TEXT},
)
cases("week_days", [("each Thursdays {k}", "Thursday"), ("Tues {k}", "Tuesday"), ("thur {k}", "Thursday"), ("monday, {k}", "Monday"), ("sunny {k}", None), ("on Sat {k}", "Saturday")], lambda x: {"day": D.parse_weekday(x)}, "DAT6.", {"day": TEXT})
cases(
    "anchor_cells",
    [("01-07", "2030-01-07"), ("Week of 1/14", "2030-01-14"), ("13-45", ""), ("a long cell with 01-07 inside of it", ""), ("02-30", ""), ("9-3 9-5", "2030-09-03 2030-09-05")],
    lambda x: {"dates": F.array_join(F.transform(D.anchor_dates(x, term("fall", 2030)), lambda d: d.cast("string")), " ")}, "DAT8.", {"dates": TEXT},
)
cases("number_forms", [("1,500", 1500), ("Twelve", 12), ("twenty-five", 25), ("zero", None), ("{k}", None), ("fifty", 50)], lambda x: {"n": F.when(~x.rlike("^[0-9]+$"), D.to_int(x))}, "NUM1.", {"n": INT})
cases("page_ranges", [("pp. 231-45", 15), ("xi–xiv; 30", 5), ("12, 14-15", 3), ("unreadable", 0), ("300ff.", 2), ("pages 9–10", 2)], lambda x: {"pages": D.page_count(x)}, "NUM2.", {"pages": INT})
cases("rounded_up", [("0.25", 0.3), ("-0.25", -0.2), ("2.45", 2.5), ("1.04", 1.0), ("89.95", 90.0)], lambda x: {"r": D.half_up(x.cast("double"))}, "NUM3.", {"r": REAL})
cases("cited_pages", [("12-30", "12-30"), ("1998", None), ("12, 14 - 15", "12, 14 - 15"), ("S1-S31", "S1-S31"), ("Chapter 3", None), ("45", "45")], lambda x: {"pages": C.pages_from_citation(x)}, "NUM4.", {"pages": TEXT})

# ---- lines

cases("line_shapes", [("Reyes {k}", "reyes #"), ("Page 10  of 12", "page # of #"), ("  Spread   OUT ", "spread out")], lambda x: {"shape": L.shape(x)}, "LAY4's shapes.", {"shape": TEXT})
cases(
    "headings",
    [("GRADING POLICY", False, True, "requirements"), ("3. Course Outline", False, True, "schedule"), ("Note on method {k}:", False, True, None), ("Academic Honesty", True, True, "policies"), ("Academic Honesty and You", True, True, "policies"), ("this is a sentence {k}.", False, False, None), ("Further Reading", True, True, "appendix"), ("a lower line", False, False, None), ("ABC", True, True, None)],
    lambda x: {"start_needed": G.is_heading(x, F.lit(True)) & ~G.is_heading(x, F.lit(False)), "heading": G.is_heading(x, F.lit(True)), "zone": G.classify_heading(x)}, "SEG2, SEG3.", {"start_needed": BOOL, "heading": BOOL, "zone": TEXT},
)
cases(
    "session_heads",
    [("Week 3: Trade {k}", True, True), ("1. Introduction (01/13)", True, True), ("January 17th: Module 1", True, False), ("Wednesday, August 19", True, False), ("Discussed in class {k}", False, False), ("Jan 9 we meet {k}", False, False), ("2) Topic {k} (Feb 3)", True, True), ("Mar 3 “The Age”", True, False)],
    lambda x: {"at_start": S.is_session_head(x, F.lit(True)), "inside": S.is_session_head(x, F.lit(False))}, "SEG8.", {"at_start": BOOL, "inside": BOOL},
)
cases(
    "split_heads",
    [("Week 3 (8/28): Trade and aid", 3, "2030-08-28", "Trade and aid"), ("Week 4: Aug 28 - Sept 1 Power", 4, "2030-08-28", "Power"), ("1. Introduction (9/13)", 1, "2030-09-13", "Introduction"), ("September 17th: Module 1: War", None, "2030-09-17", "Module 1: War"), ("Week 5 9/15-9/19", 5, "2030-09-15", None), ("Week 7", 7, None, None), ("Session 8 | Nov 12 | Peace", 8, "2030-11-12", "Peace")],
    lambda x: (lambda h: {"week": h["week"], "date": h["date"], "topic": h["topic"]})(S.split_head(x, term("fall", 2030))), "SEG20.", {"week": INT, "date": DATE, "topic": TEXT},
)
cases(
    "session_kinds",
    [("Week 3 no class, holiday {k}", "holiday"), ("Midterm exam {k}", "exam"), ("Group presentations {k}", "presentation"), ("Assignment week {k}", "assignment"), ("Course review {k}", "no_reading"), ("Just a topic {k}", "no_reading")],
    lambda x: {"kind": S.session_type(x, F.lit(None).cast("string"), F.lit(False))}, "SEG21.", {"kind": TEXT},
)
cases("levels", [("Goals", "reference"), ("Review (Inspectional Reading)", "inspectional"), ("Review", "review"), ("Recommended", "recommended"), ("Optional", "recommended"), ("Readings", "required"), ("In class", "reference"), ("Terms and key concepts", "reference")], lambda x: {"level": S.requirement_level(x)}, "EXT10, VOC3.", {"level": TEXT})
cases(
    "subheadings",
    [("Human Security", True), ("Colonial Legacies of the State", True), ("Chapter in Book", False), ("Okonkwo 2010", False), ("Single", False), ("Ends here.", False), ("lower case words", False)],
    lambda x: {"divider": S.looks_like_subheading(x)}, "EXT10, VOC13.", {"divider": BOOL},
)
cases(
    "fused_columns",
    [("NRC Ch 3 & 4 Greenfire Movie", "NRC Ch 3 & 4/-|Greenfire Movie/recommended"), ("Required Suggested", ""), ("• RLMO, Ch. 2 • Doe & Roe (2008) • Poe (2012)", "RLMO, Ch. 2/-|Doe & Roe (2008)/-|Poe (2012)/-"), ("Plain entry {k}", "Plain entry {k}/-"), ("Suggested Readings:", "")],
    lambda x: {"parts": F.array_join(F.transform(S.split_fused(x), lambda p: F.concat_ws("/", p["raw"], F.coalesce(p["level"], F.lit("-")))), "|")}, "EXT10.", {"parts": TEXT},
)
cases(
    "link_pieces",
    [("https://a.org/x y/z.html", True, False, True), ("mode/2up", False, True, True), ("NRC Ch 3 & 4", False, False, False), ("some-slug more-slug", False, True, False), (".org/details", False, False, True), ("A reading with words enough", False, False, False)],
    lambda x: {"tail": S.is_url_tail(x), "piece": S.is_url_fragment(x), "fragment": S.is_fragment(x)}, "EXT9.", {"tail": BOOL, "piece": BOOL, "fragment": BOOL},
)
cases(
    "column_labels",
    [("Week", "week"), ("Week dates (days M-F)", "week"), ("Dates", "date"), ("Topic", "topic"), ("Unit", "unit"), ("Assigned reading", "body"), ("Assignments and due dates", "body"), ("Exams and Team Assignments due", "due"), ("What's due", "due"), ("Room {k}", None)],
    lambda x: {"role": S.label_kind(x)}, "SEG12, VOC4.", {"role": TEXT},
)

# ---- citations: one case or more a shape, in the shapes' order

CITATIONS = [
    ("Doe, Jane. March 3, 2019. “A report on part {k}.” RL33110. Office of Things.", "dated_report_with_number", 2019, "A report on part {k}", "Office of Things", None, 0.9),
    ("Roe, R. May 4, 2018. “News of {k}.” Daily Paper: https://a.org/{k}.", "dated_news_with_url", 2018, "News of {k}", "Daily Paper", None, 0.9),
    ("Agency of Trade. June 5, 2017. “Plan number {k}.” Trade Papers, 4.", "dated_agency_document", 2017, "Plan number {k}", "Trade Papers", None, 0.75),
    ("Halden, Ida B. December 2022. Primer on planning {k}. Research Service", "dated_unquoted_report", 2022, "Primer on planning {k}", "Research Service", None, 0.75),
    ("eCFR :: 22 CFR Part 888 -- The List of {k}", "cfr_citation", None, "The List of {k}", None, None, 0.6),
    ("The Control List eCFR :: 15 CFR Part 999 -- The Control List", "cfr_citation", None, "The Control List", None, None, 0.6),
    ("Doe, Jane. 1999. “On part {k}.” In The Whole Thing, Boston: Press.", "author_date_chapter", 1999, "On part {k}", "The Whole Thing", None, 0.9),
    ("Doe, J. 2001. “A study of {k}.” Journal of Things 12 (3): 45–67.", "author_date_journal", 2001, "A study of {k}", "Journal of Things", "45-67", 0.95),
    ("Doe, J. 2001. “A study of {k}.” Journal of Things, 12", "author_date_journal", 2001, "A study of {k}", "Journal of Things", None, 0.95),
    ("Poe, Ann. 2003. A quiet study of {k}. Journal of Quiet 9: 1-20.", "author_date_unquoted_journal", 2003, "A quiet study of {k}", "Journal of Quiet", "1-20", 0.8),
    ("Museum Staff. “Timeline {k}.” In Art Timeline. New York: The Museum, 2000–", "series_entry_open_ended", 2000, "Timeline {k}", "Art Timeline", None, 0.85),
    ("Rao, Priya, “Teaching {k},” in Site of Teaching, https://t.org/{k}", "web_resource_in_site", None, "Teaching {k}", "Site of Teaching", None, 0.8),
    ("Halden, Ida A. and Tom Berg (eds.), Politics Today {k}. New York, etc: Longman, 2010, 4th edition, chapter 1.", "book_year_last", 2010, "Politics Today {k}", None, "chapter 1", 0.85),
    ("Halden, Ida. Patterns of Rule {k}. New Haven; London: Yale Press, 2012, second edition, chapters 1-3.", "book_year_last", 2012, "Patterns of Rule {k}", None, "chapters 1-3", 0.85),
    ("Doe, Jane. 2005. The long book {k}. Boston: Big Press.", "author_date_book", 2005, "The long book {k}", None, None, 0.75),
    ("Okonkwo (12) in Comparative Rule.", "chapter_in_container", None, None, "Comparative Rule", "chapter 12", 0.7),
    ("Lind (15) and Osei (14) in Comparative Rule.", "chapter_in_container", None, None, "Comparative Rule", "chapters 15, 14", 0.7),
    ("Hine in Hale & Osei", "chapter_in_container", None, None, "Hale & Osei", None, 0.7),
    ("NRC Ch 3 & 4", "author_short_chapter", None, None, None, "Ch 3 & 4", 0.7),
    ("NRC Ch 12; Fish film {k}", "author_short_chapter", None, None, None, "Ch 12", 0.7),
    ("Chapters 3.1, 3.2", "chapter_reference", None, None, None, "3.1, 3.2", 0.65),
    ("Sections 2.1 and 2.3 The limits of what can be known about one function, in Calculus of {k}", "numbered_sections_in_work", None, "The limits of what can be known about one function", "Calculus of {k}", "sections 2.1 and 2.3", 0.7),
    ("Pages 29-37 in The Ledger {k}", "page_range_in_work", None, None, "The Ledger {k}", "29-37", 0.7),
    ("Someone, “A loose title {k},” a magazine", "quoted_title_loose", None, "A loose title {k}", "a magazine", None, 0.55),
    ("A page about {k}: https://a.org/x{k}", "titled_with_bare_url", None, "A page about {k}", None, None, 0.5),
    ("Book: Hazard of {k}; Chapter 1", "named_book_chapter", None, "Hazard of {k}", None, "1", 0.7),
    ("Book: Globes of {k}: Networks and Rules", "named_book", None, "Globes of {k}: Networks and Rules", None, None, 0.6),
    ("Hazard Analysis: Chapters 3 and 7", "set_text_chapters", None, "Hazard Analysis", None, "3 and 7", 0.6),
    ("Levin, Steve, and Dan Zib. 2018. How Rules Die {k}. Crown.", "author_date_book", 2018, "How Rules Die {k}", None, None, 0.7),
    ("Rosen, Ann, eds. 2005. Handbook of {k}. Sage Books.", "author_date_book", 2005, "Handbook of {k}", None, None, 0.7),
    ("Chapter 3 Earnings and Income: The building blocks of your budget planning", "chapter_with_title", None, "Earnings and Income: The building blocks of your budget planning", None, "3", 0.6),
    ("Gib, Mill, & Little (2016)", "author_year_short", 2016, None, None, None, 0.5),
    ("Goer (2020), Ch. 2-3", "author_year_short", 2020, None, None, "Ch. 2-3", 0.5),
    ("Country Profiles {k} | The Data Project", "page_title_with_site", None, "Country Profiles {k}", "The Data Project", None, 0.55),
    ("Discussed in class", None, None, None, None, None, None),
]


def _cited(x):
    c = C.parse_citation(x)
    return {"matched_pattern": c["matched_pattern"], "year": c["year"], "title": c["title"], "container": c["container"], "pages": c["pages"], "confidence": c["confidence"]}


cases("citation_shapes", CITATIONS, _cited, "EXT1, EXT2, EXT4: every shape.", {"matched_pattern": TEXT, "year": INT, "title": TEXT, "container": TEXT, "pages": TEXT, "confidence": REAL})
cases(
    "citation_parts",
    [("Doe, J. 2001. “A study {k}.” Journal of Things 12 (3): 45–67. doi:10.1234/ab.{k}", "12", "3", "10.1234/ab.{k}", None, None, None), ("Roe, R. May 4, 2018. “News.” Daily Paper: https://a.org/{k}.", None, None, None, "https://a.org/{k}", None, None), ("Museum Staff. “Timeline.” In Art. New York: The Museum, 2000-2010", None, None, None, None, 2010, False), ("Museum Staff. “Timeline.” In Art. New York: The Museum, 2000-", None, None, None, None, None, True), ("Doe, J. 2001. “A study.” Journal of Things 12: 1998.", "12", None, None, None, None, False)],
    lambda x: (lambda c: {"volume": c["volume"], "issue": c["issue"], "doi": c["doi"], "url": c["url"], "year_end": c["year_end"], "is_open": F.when((c["matched_pattern"] == "series_entry_open_ended") | c["pages"].isNull() & c["volume"].isNotNull(), c["year_is_open"])})(C.parse_citation(x)), "EXT2.", {"volume": TEXT, "issue": TEXT, "doi": TEXT, "url": TEXT, "year_end": INT, "is_open": BOOL},
)
cases(
    "author_lists",
    [("Doe, Jane, Ann Lee, and Bo Ray", "Doe,Jane|Lee,Ann|Ray,Bo"), ("World Health Organization", "World Health Organization"), ("Levin, Steve, and Dan Zib", "Levin,Steve|Zib,Dan"), ("Osei et al.", "Osei,|et al."), ("Dr. Ida Berg", "Berg,Ida"), ("Smith, J. R.", "Smith,J. R."), ("Plato", "Plato,"), ("Doe, Jane; Roe, R.", "Doe,Jane|Roe,|R.,")],
    lambda x: {"authors": F.array_join(F.transform(C.parse_authors(x), lambda a: F.coalesce(a["literal"], F.concat_ws(",", a["surname"], F.coalesce(a["given"], F.lit(""))))), "|")}, "EXT3.", {"authors": TEXT},
)
cases("signatures", [("Doe, Jane|2001|A Study: of Things, and more words", "doe|2001|a study of things and more"), ("World Bank||Report {k}", "world bank||report {k}"), ("||", None)], lambda x: {"signature": C.signature(C.parse_authors(F.get(F.split(x, r"\|"), 0)), D.blank(F.get(F.split(x, r"\|"), 1)), F.get(F.split(x, r"\|"), 2))}, "EXT5.", {"signature": TEXT})
cases("placeholders", [("TBD", True), ("Readings: TBA.", True), ("to be announced", True), ("To be read {k}", False), ("Reading {k}: to be determined", True)], lambda x: {"placeholder": C.is_placeholder(x)}, "EXT6.", {"placeholder": BOOL})
cases(
    "prose",
    [("This week we will look at how states that have been at war come to terms with what was lost and gained {k}", True), ("Doe, Jane. 2001. A very long title that goes on and on with many words in it and is still a citation to be read", False), ("Short line {k}", False), ("The essay “a title of four words” is what we will read this week and discuss in class with all the others here {k}", False), ("We will read pp. 12 to 30 and then see what can be said about it in the light of what was read before {k}", False)],
    lambda x: {"prose": C.looks_like_prose(x)}, "EXT8.", {"prose": BOOL},
)

# ---- graded work and policies

cases("work_kinds", [("Quiz {k}", "exam"), ("Weekly Assessment {k}", "weekly_assessment"), ("Reading Checklist", "checklist"), ("Prospectus {k}", "proposal"), ("Class presentation", "presentation"), ("Case studies {k}", "case_study"), ("Sign-up sheet", "signup"), ("Policy memo {k}", "essay"), ("Lab reports", "report"), ("Participation {k}", "other"), ("Examples {k}", "other")], lambda x: {"kind": W.classify_kind(x, F.lit(""))}, "EXT13, VOC5.", {"kind": TEXT})
cases(
    "stances",
    [("AI is fine {k}", "unstated"), ("ChatGPT must not be used {k}", "prohibited"), ("Generative AI only with permission {k}", "restricted"), ("You may use a large language model {k}", "permitted"), ("We discuss artificial intelligence {k}", "restricted"), ("Unless explicitly stated, an LLM is not allowed {k}", "prohibited")],
    lambda x: {"stance": P.ai_stance(x)}, "EXT17, VOC9.", {"stance": TEXT},
)
cases("policy_types", [("Late work loses a grade {k}", "late_work"), ("Attendance is required {k}", "attendance"), ("The grading scale is below {k}", "grading_scale"), ("The honor code binds all {k}", "academic_honesty"), ("FERPA protects you {k}", "boilerplate"), ("Use of ChatGPT {k}", "ai_use"), ("Bring a book {k}", "other")], lambda x: {"kind": P.policy_type(F.lit(None).cast("string"), x)}, "EXT17, VOC9.", {"kind": TEXT})
cases("work_keys", [("Research Paper (final) {k}", "researchpaper{k}"), ("Essay #1!", "essay1"), ("(only)", "")], lambda x: {"merge_key": W.merge_key(x)}, "AGG7's key.", {"merge_key": TEXT})
cases("work_titles", [("may cut a grade. Week {k} Essay:", "Week {k} Essay", "may cut a grade. Week {k} Essay"), ("=F Attendance", "=F Attendance", "Attendance"), ("87 Quizzes,", "87 Quizzes", "Quizzes")], lambda x: {"tidy": W.tidy_title(x), "clean": W.clean_title(x)}, "EXT15.", {"tidy": TEXT, "clean": TEXT})
cases("bonus_titles", [("Extra Credit {k}", True), ("bonus points", True), ("Bonuses {k}", False), ("Essay {k}", False)], lambda x: {"bonus": A.is_bonus(x)}, "AGG10's bonus.", {"bonus": BOOL})
cases("letters", [("93", "A", "A"), ("92.9", "A-", "A"), ("60", "D", "D"), ("12", "F", "F"), ("85", "B", "B"), ("88", "B+", "B")], lambda x: {"plus_minus": A.letter_on(x.cast("double"), A.resolve_scale(F.lit("plusminus"))), "straight": A.letter_on(x.cast("double"), A.resolve_scale(F.lit("straight")))}, "AGG12, VOC15.", {"plus_minus": TEXT, "straight": TEXT})

# ---- front matter and kinds

cases(
    "course_codes", [("FALL 2030\nPOLS 4101 {k}", "POLS 4101"), ("Course Number: 4316", "4316"), ("INTL-3300H {k}", "INTL 3300H"), ("SPRING 2031 only", None)],
    lambda x: {"code": M.course_code(x)}, "EXT11.", {"code": TEXT},
)
cases("names", [("Dr. Priya Raman", "Dr. Priya Raman"), ("will be happy to help", None), ("____ ", None), ("Office Hours", None), ("Dana Okafor (dana@x.org)", "Dana Okafor"), ("He left. Then she came", None)], lambda x: {"name": M.plausible_name(x)}, "EXT11.", {"name": TEXT})
cases(
    "kind_scores",
    [("Syllabus, office hours\nWeek 1\nWeek 2\nWeek 3\nExam 30% and essay 20%", 0.95, "syllabus", 0.9), ("Abstract. doi 10.1234/x{k}\nReferences", -0.45, "reading", 1.0), ("Week 1 in an article", 0.1, "reading", 0.8), ("1/2 1/3 1/4 1/5 1/6 dates", 0.25, "reading", 0.5), ("A: 93\nB: 83", 0.2, "reading", 0.6), ("instructor and late work, Week 1, Week 2, Week 9", 0.6, "syllabus", 0.2)],
    lambda x: (lambda s: {"score": s["score"], "kind": s["kind"], "confidence": s["confidence"]})(M.kind_of(x, x, F.lit(False))), "EXT18, VOC18.", {"score": REAL, "kind": TEXT, "confidence": REAL},
)
cases("worth_rescuing", [("Okonkwo, T. A study of rule and law, 2004 {k}", True), ("too short 2004", False), ("“A quoted title of some length” in places {k}", True), ("a sentence with many plain words in two thousand four {k}", False), ("https://a.org/{k}/very/long/link", False), ("in class we will look at Berg, Ida 2004 {k}", False)], lambda x: {"worth": R.worth_rescuing(x)}, "EXT19.", {"worth": BOOL})
cases("record_types", [("journal-article", "journal_article"), ("monograph", "book"), ("book-part", "book_chapter"), ("report-component", "report"), ("posted-content", "unknown")], lambda x: {"work_type": R.work_type(x)}, "EXT20, VOC11.", {"work_type": TEXT})

# ---- rendering and publishing


def _parts(x):
    f = F.split(x, r"\|")
    at = lambda i: D.blank(F.get(f, i))
    return C.parse_authors(F.coalesce(at(0), F.lit(""))), at(1), at(2), at(3), at(4), at(5), at(6)


def _rendered(x):
    a, y, t, c, v, i, p = _parts(x)
    none = F.lit(None).cast("string")
    return {s: C.render(s, a, y, t, c, v, i, p, none, none) for s in C.STYLES} | {"label": C.short_label(a, y, t)}


ONE, TWO, BARE = "Doe, Jane|2001|A study {k}|Journal|12|3|4-5", "Doe, Jane, and Ann Lee|1999|Parts {k}|Whole|||", "|2003|Only {k}||||"
cases(
    "rendered",
    [
        (ONE, 'Doe, Jane. 2001. "A study {k}." Journal. 12(3): 4-5.', "Doe, J. (2001). A study {k}. Journal. 12(3): 4-5.", 'Doe, Jane. "A study {k}." Journal. 12(3): 4-5. 2001.', 'Doe, Jane. 2001. "A study {k}." Journal. 12(3): 4-5.', 'Doe, J. (2001). "A study {k}." Journal. 12(3): 4-5.', "Doe 2001, A study {k}"),
        (TWO, 'Doe, Jane, and Ann Lee. 1999. "Parts {k}." Whole.', "Doe, J., and Lee, A. (1999). Parts {k}. Whole.", 'Doe, Jane, and Ann Lee. "Parts {k}." Whole. 1999.', 'Doe, Jane, and Ann Lee. 1999. "Parts {k}." Whole.', 'Doe, J., and Lee, A. (1999). "Parts {k}." Whole.', "Doe 1999, Parts {k}"),
        (BARE, '2003. "Only {k}."', "(2003). Only {k}.", '"Only {k}." 2003.', '2003. "Only {k}."', '(2003). "Only {k}."', "2003, Only {k}"),
    ],
    _rendered, "SRV11: five styles and the short label.", {s: TEXT for s in (*C.STYLES, "label")},
)
cases("links", [("10.1234/a{k}|http://b.org", "https://doi.org/10.1234/a{k}"), ("|http://b.org/{k}).", "http://b.org/{k}"), ("|", None)], lambda x: {"href": C.reading_link(F.get(F.split(x, r"\|"), 0), F.get(F.split(x, r"\|"), 1))}, "SRV12.", {"href": TEXT})
cases("page_notes", [("12-30|Okonkwo, pp. 12-30", None), ("1 - 9|Okonkwo {k}", "1 - 9"), ("5|Doe 2001", "5")], lambda x: {"note": C.page_note(F.get(F.split(x, r"\|"), 0), F.get(F.split(x, r"\|"), 1))}, "SRV13.", {"note": TEXT})
cases("keys_of_readings", [("7|doe|2001|x", "7:sig"), ("7|", "7:#3")], lambda x: {"reading_key": C.reading_key(F.lit(7), F.when(x.contains("doe"), F.lit("sig")), F.lit(3))}, "KEY1.", {"reading_key": TEXT})
cases("forbidden_shapes", [("instructor_email x", "instructor email field"), ("a@b.edu and chunk_text {k}", "an academic email address, extracted reading text"), ("clean {k}", ""), ("generated_by: model", "model generated content")], lambda x: {"reasons": F.array_join(X.forbidden_reasons(x), ", ")}, "PRJ3.", {"reasons": TEXT})
cases("lower_codes", [("ABC 12{k}", "abc12{k}"), ("abc12 {k}", "abc12{k}")], lambda x: {"code": F.lower(F.replace(x, F.lit(" "), F.lit("")))}, "PRJ7's comparison.", {"code": TEXT})
