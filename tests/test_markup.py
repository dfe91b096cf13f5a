"""Generated XML, research texts, slide plans and workshops: literal cases and plain re-statements."""

import re

import pytest

from atlasloom.constants import FORCED_CONCLUSION
from atlasloom.functions import decks, markup, research
from atlasloom.operators.wiki import root_sections
from atlasloom.plans.wikis import flatten_wiki_xml, ingest_wiki, slide_plans

GOOD = """```xml
<wiki_structure>
  <title>My & Wiki</title>
  <description>About\x01 it</description>
  <sections>
    <section id="s1"><title>One</title><pages><page_ref>p1</page_ref></pages>
      <subsections><section_ref>s2</section_ref></subsections></section>
    <section id="s2"><title>Two</title><pages><page_ref>p2</page_ref><page_ref></page_ref></pages></section>
    <section id="s3"><title>Self</title><pages></pages><subsections><section_ref>s3</section_ref></subsections></section>
    <section><title>Unnamed</title></section>
  </sections>
  <pages>
    <page id="p1"><title>A &lt;b&gt;</title><importance>high</importance>
      <relevant_files><file_path>a.py</file_path><file_path></file_path><file_path>b.py</file_path></relevant_files>
      <related_pages><related>p2</related></related_pages></page>
    <page><title>No id</title></page>
    <page id="p3"><title>Odd</title><importance>critical</importance></page>
    <page id="p4"><title>Padded</title><importance> high </importance></page>
  </pages>
</wiki_structure>
```"""
BROKEN = """<wiki_structure><title> T </title><description> D </description><pages>
<page id="x"><title> X < Y </title><importance>low</importance><file_path> f.py </file_path>
<related> y </related></page><page id="y"><title>Y</title></page></pages></wiki_structure> tail"""


def test_flatten_wiki_xml(spark):
    df = spark.createDataFrame([("g", GOOD), ("b", BROKEN), ("n", "nothing here")], "wiki_id string, response string")
    wikis, pages, sections = flatten_wiki_xml(df)
    got = {r.wiki_id: r for r in wikis.collect()}
    assert (got["g"].title, got["g"].description, got["g"].rebuilt, got["g"].error) == ("My & Wiki", "About it", False, None)
    assert (got["b"].rebuilt, got["b"].title) == (True, "T")
    assert got["n"].error == "No valid XML found in response"

    rows = sorted(pages.collect(), key=lambda r: (r.wiki_id, r.page_ord))
    assert [(r.wiki_id, r.page_id, r.title, r.importance, r.file_paths, r.related_pages) for r in rows] == [
        ("b", "x", "X < Y", "low", ["f.py"], ["y"]),
        ("b", "y", "Y", "medium", [], []),
        ("g", "p1", "A <b>", "high", ["a.py", "b.py"], ["p2"]),
        ("g", "page-2", "No id", "medium", [], []),
        ("g", "p3", "Odd", "low", [], []),
        ("g", "p4", "Padded", "low", [], []),
    ]
    secs = sorted(sections.collect(), key=lambda r: r.sec_ord)
    assert [(r.section_id, r.title, r.pages, r.subsections) for r in secs] == [
        ("s1", "One", ["p1"], ["s2"]), ("s2", "Two", ["p2"], []), ("s3", "Self", [], ["s3"]),
        ("section-4", "Unnamed", [], []),
    ]
    assert {r.section_id for r in root_sections(sections).collect()} == {"s1", "section-4"}
    assert flatten_wiki_xml(df, comprehensive=False)[2].count() == 0


def test_ingest_infers_sections_only_where_missing(spark):
    df = spark.createDataFrame([("g", GOOD), ("b", BROKEN)], "wiki_id string, response string")
    out = ingest_wiki(df)
    assert {r.wiki_id for r in out["inferred_pages"].collect()} == {"b"}
    assert [(r.section_id, r.n_pages) for r in out["inferred_sections"].collect()] == [("section-other", 2)]


def test_fences(evaluate):
    rows = [("```Markdown\n# a\n```  \n",), ("# a\n``` b",), ("```markdown```",)]
    want = [
        re.sub(r"```\s*\Z", "", re.sub(r"\A```markdown\s*", "", r[0], flags=re.I), flags=re.I) for r in rows
    ]
    assert evaluate(markup.strip_fences, rows, "s string") == want
    assert evaluate(lambda c: markup.strip_fences(c, "xml"), [("```xml\n<a/>\n```",), ("```\n<a/>",)], "s string") == ["<a/>\n", "<a/>"]


def test_repair_xml(evaluate):
    rows = [("a & b &amp; c &nbsp; &lt;  >",)]
    assert evaluate(markup.repair_xml, rows, "s string") == ["a &amp; b &amp; c &amp;nbsp; &lt;>"]


def test_page_summary(evaluate):
    texts = ["# T\n\n First para. \n\nmore", "# T\nno blank", "# T\n\nlast line", "# T\n\n\n\nx", "# T\n\nline1\nline2\n\nx", "plain"]
    want = []
    for x in texts:
        m = re.search(r"# .*?\n\n(.*?)(\n\n|\Z)", x)
        want.append(m.group(1).strip() if m else "No summary available")
    assert evaluate(markup.page_summary, [(x,) for x in texts], "s string") == want


@pytest.mark.parametrize(
    "text,complete",
    [
        ("## Final Conclusion\nx", True), ("## Summary\nall done", True), ("## Summary\n## Next Steps", False),
        ("## Conclusion I will now proceed to", False), ("This concludes our research", True),
        ("Final words, in Conclusion", True), ("This Dockerfile does it", True),
        ("This Dockerfile ... Next Steps", False), ("nothing", False), ("", False),
    ],
)
def test_research_complete(evaluate, text, complete):
    assert evaluate(research.research_complete, [(text,)], "s string") == [complete]


def test_research_stage_and_force(evaluate):
    rows = [
        ("## Research Plan\nx", 1), ("## Research Plan\nx", 2), ("## Research Update 1", 1),
        ("## Research Update 10", 1), ("## Research Update 4", 4), ("## Research Update 5", 5),
        ("## Final Conclusion", 3), ("x", 1),
    ]
    got = evaluate(research.research_stage, rows, "s string, i int")
    assert [None if g is None else (g.type, g.title, g.iteration) for g in got] == [
        ("plan", "Research Plan", 1), None, ("update", "Research Update 1", 1), ("update", "Research Update 1", 1),
        ("update", "Research Update 4", 4), None, ("conclusion", "Final Conclusion", 3), None,
    ]
    forced = evaluate(research.force_complete, [("x", 5), ("x", 4), ("In conclusion, x", 6)], "s string, i int")
    assert [tuple(f) for f in forced] == [
        ("x" + FORCED_CONCLUSION, True, True), ("x", False, False), ("In conclusion, x", True, False),
    ]


def _plan(text, repo):
    for p, flags in (
        (r"\d+\.\s+(.*?)(?=\n\d+\.|\n*\Z)", 0), (r"\d+\)\s+(.*?)(?=\n\d+\)|\n*\Z)", 0),
        (r"Slide\s+\d+\s*:?\s*(.*?)(?=\nSlide|\n*\Z)", re.I),
    ):
        found = re.findall(p, text, flags)
        if found:
            return found
    loose = [m[0] for m in re.findall(r"^([^:\n]+)(?::\s*(.*?))?$", text, re.M)]
    loose = [x for x in loose if len(x) > 3 and "please" not in x.lower() and "here" not in x.lower()]
    return loose or [
        f"Title Slide: Introduction to {repo}", f"Overview: Key features and purpose of {repo}",
        "Architecture: System components and structure", "Features: Main capabilities and functionalities",
        "Implementation: How it works and technical details", f"Use Cases: How to use {repo} effectively",
        "Conclusion: Summary and next steps",
    ]


def test_slide_plans(spark):
    texts = [
        "1. Intro: hello: more\n2. Body: x\n3. End", "1. A: b\n\n2. C: d\n\n3. E: f\n", "1) One: a\n2) Two",
        "Slide 1: First: x\nslide 2 Second\nSlide 3: Third", "Overview: x\nhere it is\nabc\nDetails of it", "", "a\nb",
        "Intro text\n1. Only: one\ncontinued", "1.5 million 2. x",
    ]
    df = spark.createDataFrame([(str(i), "rp", x) for i, x in enumerate(texts)], "wiki_id string, repo string, plan string")
    got = {}
    for r in sorted(slide_plans(df).collect(), key=lambda r: r.slide_no):
        got.setdefault(int(r.wiki_id), []).append((r.title, r.description))
    for i, text in enumerate(texts):
        want = [(x.split(":")[0].strip(), x.split(":")[1].strip() if ":" in x else "") for x in _plan(text, "rp")]
        assert got[i] == want, text
    robust = slide_plans(df, "robust").filter("wiki_id = '1'").count()
    assert robust == 3


def _html(s):
    out = ""
    m = re.search(r"```(?:html)?\s*([\s\S]*?)\s*```", s)
    if m:
        out = m.group(1)
    elif '<div class="slide"' in s:
        m = re.search(r'<div class="slide"[\s\S]*?</div>\s*</div>', s)
        out = m.group(0) if m else ""
    elif "<" in s and ">" in s:
        m = re.search(r"<[\s\S]*?>", s)
        tag = m and re.search(r"<([a-z][a-z0-9]*)", m.group(0), re.I)
        if tag:
            m = re.search(rf"<{tag.group(1)}[\s\S]*?</{tag.group(1)}>", s, re.I)
            out = m.group(0) if m else ""
    return out or s


def test_slide_html(evaluate):
    texts = [
        "x ```html\n<p>a</p>\n``` y", "```\n\n```", 'a <div class="slide"><div>x</div> </div> z',
        '<div class="slide">open', "see <Section a=1>b</section> <p>c</p>", "<!DOCTYPE html><html>x</html>",
        "a > b < c", "plain", "<br> only", "<h1>one\ntwo</H1>",
    ]
    assert evaluate(decks.slide_html, [(x,) for x in texts], "s string") == [_html(x) for x in texts]


def _workshop(c):
    if "## Table of Contents" not in c and "## Contents" not in c:
        hs = re.findall(r"^## (.*)$", c, re.M)
        if hs:
            toc = "## Table of Contents\n\n" + "".join(
                f"- [{h}](#{re.sub(r'\s+', '-', re.sub(r'[^\w\s-]', '', h.lower(), flags=re.A))})\n" for h in hs
            ) + "\n"
            intro = c.find("# ") + 1
            nxt = c.find("## ", intro)
            if nxt > intro:
                c = c[:nxt] + toc + c[nxt:]
    div = '<div style="text-align: right; font-size: 0.85em; color: #666;">\n'
    ex = re.findall(r"^## Exercise \d+:", c, re.M)
    n = len(ex)
    for i, h in enumerate(ex):
        minutes = 5 if i == 0 else 15 if i == n - 1 else 12 if i > n // 2 else 10
        note = f"{div}Exercise {i + 1} of {n} | Estimated time: {minutes} minutes\n</div>\n\n"
        pos = c.find(h)
        end = c.find("\n", pos)
        if end != -1:
            c = c[: end + 1] + note + c[end + 1 :]
    m = re.search(r"^## Final Project", c, re.M)
    if m:
        end = c.find("\n", c.find(m.group(0)))
        if end != -1:
            note = f"{div}Estimated time: 20-30 minutes | Combines concepts from all exercises\n</div>\n\n"
            c = c[: end + 1] + note + c[end + 1 :]
    return c


def test_workshops(spark):
    from atlasloom.plans.wikis import workshops

    texts = [
        "# W\nintro\n## Setup & Go!\nx\n## Exercise 1: a\nt\n## Exercise 2: b\nt\n## Exercise 3: c\n## Exercise 10: d\ny\n## Final Project\nz\n",
        "## Only\nx", "# T\n### Deep\n## Two words  here\n", "# T\n## Contents\n- x\n## Exercise 1: a\nx",
        "no headings", "# T\n## Exercise 1: same\na\n## Exercise 1: same\nb\n", "## Exercise 1: last", "# É\n## Çà été\nx",
    ]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, text string")
    got = [r.text for r in sorted(workshops(df).collect(), key=lambda r: r.i)]
    for g, x in zip(got, texts):
        assert g == _workshop(x), x


def test_elements_at_any_depth(spark):
    xml = """<wiki_structure><title>T</title><description>D</description><sections>
<section id="s1"><title>One</title><pages><page_ref>p1</page_ref></pages><page id="p1"><title> in &amp; s1 </title><importance>high</importance>
<file_path>a.py</file_path></page><section id="s2"><title>Two</title><pages><page_ref>p2</page_ref></pages></section></section></sections>
<pages><page id="p2"><title>plain</title><related_pages><related>p1</related></related_pages></page></pages></wiki_structure>"""
    _, pages, sections = flatten_wiki_xml(spark.createDataFrame([("w", xml)], "wiki_id string, response string"))
    assert [(p.page_ord, p.page_id, p.title, p.importance, p.file_paths, p.related_pages) for p in sorted(pages.collect(), key=lambda p: p.page_ord)] == [
        (0, "p1", " in & s1 ", "high", ["a.py"], []), (1, "p2", "plain", "medium", [], ["p1"])
    ]
    assert [(s.section_id, s.title, s.pages) for s in sorted(sections.collect(), key=lambda s: s.sec_ord)] == [
        ("s1", "One", ["p1", "p2"]), ("s2", "Two", ["p2"])  # an element's references are all below it
    ]


def test_sections_folded_with_a_stack(evaluate):
    """Three levels, lone tags, comments, stray and missing ends, against a plain stack."""
    import re

    from atlasloom.functions.markup import sections_from_xml

    def plain(xml):
        xml = re.sub(r"(?s)<!--.*?-->", "", xml)
        stack, out = [], []
        for shut, name, attributes, lone, text in re.findall(r"<(/?)(section|title|page_ref|section_ref)(?=[\s/>])((?:\s[^>]*?)?)(/?)>([^<]*)", xml):
            text = text.replace("&amp;", "&")
            if name == "section" and shut:
                stack[-1:] = []
            elif name == "section":
                given = re.search(r"""\sid\s*=\s*["']([^"']*)""", attributes)
                own = [given and given[1] or f"section-{len(out) + 1}", None, [], [], len(stack), out[stack[-1]][0] if stack else None]
                stack.append(len(out))
                out.append(own)
                if lone:
                    stack.pop()
            elif not shut:
                for i in stack:
                    if name == "title":
                        out[i][1] = text if out[i][1] is None else out[i][1]
                    elif text:
                        out[i][2 if name == "page_ref" else 3].append(text)
        return [(i, t or "", p, s, d, q) for i, t, p, s, d, q in out]

    deep = "".join(f'<section id="d{i}"><title>D{i}</title>' for i in range(60)) + "<page_ref>p</page_ref>" + "</section>" * 60
    cases = [
        "", "<title>no section</title>", "<section/><section id='a'/>", "</section><section><title>A &amp; B</title></section>",
        '<section id="x"><section><section id = "z"><page_ref>1</page_ref></section><page_ref></page_ref></section><section_ref>q</section_ref><title>late</title></section>',
        "<section><!-- <section> --><page_ref>1</page_ref>", deep, "<sections><section id=''><title/></section></sections>",
    ]
    got = evaluate(sections_from_xml, [(c,) for c in cases], "xml string")
    assert [[tuple(s) for s in sections] for sections in got] == [plain(c) for c in cases]
