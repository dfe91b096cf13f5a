"""Column functions against plain re-statements and literal cases."""

import urllib.parse

from atlasloom.functions import text as t, urls as u


def test_repo_names(evaluate):
    rows = [
        ("https://github.com/owner/repo", "github", "owner_repo"),
        ("https://github.com/owner/repo.git", "github", "owner_repo"),
        ("https://github.com/owner/repo/", "github", "owner_repo"),
        ("https://gitlab.com/owner/repo", "gitlab", "owner_repo"),
        ("https://gitlab.com/group/subgroup/repo", "gitlab", "subgroup_repo"),
        ("https://bitbucket.org/owner/repo", "bitbucket", "owner_repo"),
        ("/home/user/projects/my-repo", "local", "my-repo"),
        ("/var/repos/project.git", "local", "project"),
        ("https://github.com/repo", "github", "repo"),
        ("my-repo", "local", "my-repo"),
    ]
    assert evaluate(u.repo_name, [r[:2] for r in rows], "url string, kind string") == [r[2] for r in rows]


def test_repo_inputs(evaluate):
    cases = {
        " https://github.com/owner/repo.git ": ("owner", "repo", "github", "owner/repo", None),
        "github.com/owner/repo/": ("owner", "repo", "github", "owner/repo", None),
        "https://gitlab.example.org/a/b/c": ("b", "c", "gitlab", "a/b/c", None),
        "https://bitbucket.org/o/r": ("o", "r", "bitbucket", "o/r", None),
        "https://git.host.net/o/r": ("o", "r", "web", "o/r", None),
        "/home/me/proj/": ("local", "proj", "local", None, "/home/me/proj/"),
        "C:\\code\\proj": ("local", "proj", "local", None, "C:\\code\\proj"),
        "/": ("local", "local-repo", "local", None, "/"),
        "justaname": None,
        "github.com/owner": None,
    }
    found = evaluate(u.parse_repo_input, [(k,) for k in cases], "s string")
    got = [None if f is None else (f.owner, f.repo, f.type, f.full_path, f.local_path) for f in found]
    assert got == list(cases.values())


def test_url_parts(evaluate):
    inputs = [("https://Host.com:8080/a/b/",), ("host.com/x?q=1#f",), ("http://h.com:80",), ("https://",), ("http://h.com:443/p",)]
    assert evaluate(u.url_domain, inputs, "s string") == [
        "https://host.com:8080", "https://host.com", "http://h.com", None, "http://h.com:443",
    ]
    assert evaluate(u.url_path, inputs, "s string") == ["a/b", "x", "", None, "p"]


def test_file_urls(evaluate):
    rows = [
        ("github", "https://github.com/o/r", "main", "a.py"),
        ("web", "https://gitlab.corp/o/r", "dev", "a.py"),
        ("bitbucket", "https://bitbucket.org/o/r", "main", "a.py"),
        ("web", "https://elsewhere.org/o/r", "main", "a.py"),
        ("local", "https://github.com/o/r", "main", "a.py"),
        ("github", None, "main", "a.py"),
        ("github", "not a url", "main", "a.py"),
    ]
    assert evaluate(u.file_url, rows, "k string, u string, b string, p string") == [
        "https://github.com/o/r/blob/main/a.py", "https://gitlab.corp/o/r/-/blob/dev/a.py",
        "https://bitbucket.org/o/r/src/main/a.py", "a.py", "a.py", "a.py", "a.py",
    ]


def test_repo_url_precedence(evaluate):
    rows = [
        ("local", "o", "r", "/p", "http://x"), ("github", "o", "r", "/p", "http://x"),
        ("github", "o", "r", None, None), ("github", "", "r", None, ""),
    ]
    assert evaluate(u.repo_url, rows, "k string, o string, r string, p string, u string") == [
        "/p", "http://x", "http://example/o/r", "",
    ]


def test_cache_keys(evaluate):
    from pyspark.sql import functions as F

    built = evaluate(u.cache_key, [("github", "o", "a_b", "en")], "k string, o string, r string, l string")
    assert built == ["wiki_cache_github_o_a_b_en.json"]
    names = [
        ("wiki_cache_github_o_r_en.json",), ("wiki_cache_github_o_a_b_en.json",),
        ("wiki_cache_github_my_org_r_en.json",), ("wiki_cache_github_en.json",), ("other_github_o_r_en.json",),
    ]
    found = [None if p is None else tuple(p) for p in evaluate(u.parse_cache_key, names, "n string")]
    assert found == [
        ("github", "o", "r", "en"), ("github", "o", "a_b", "en"), ("github", "my", "org_r", "en"), None, None,
    ]
    view = evaluate(lambda k: u.cache_key(k, k, k, k, F.lit("concise")), [("x",)], "k string")
    assert view == ["wiki_cache_x_x_x_x_concise"]


def test_token_counts(evaluate):
    texts = ["", "abc", "abcd", "é" * 9, " a  b\n\tc\u00a0d ", "one"]
    assert evaluate(t.count_tokens, [(x,) for x in texts], "s string") == [len(x) // 4 for x in texts]
    assert evaluate(t.estimate_tokens, [(x,) for x in texts], "s string") == [len(x.split()) for x in texts]


def test_utf16_length(evaluate):
    texts = ["", "aé", "a😀b"]
    want = [len(x.encode("utf-16-be")) // 2 for x in texts]
    assert evaluate(t.utf16_length, [(x,) for x in texts], "s string") == want


def _windows(text, size, overlap):
    words, out, i = text.split(" "), [], 0
    while True:
        out.append(" ".join(words[i : i + size]))
        if i + size >= len(words):
            return out
        i += size - overlap


def test_chunks_match_restatement_and_cover_the_text(evaluate):
    texts = ["", "a", " ".join(map(str, range(5))), " ".join(map(str, range(10))), "x  y " * 11, "w " * 23]
    for size, overlap in ((5, 2), (4, 0), (3, 2)):
        got = evaluate(lambda c: t.chunk_texts(c, size, overlap), [(x,) for x in texts], "s string")
        assert got == [_windows(x, size, overlap) for x in texts]
        for text, parts in zip(texts, got):
            words = parts[0].split(" ")
            for part in parts[1:]:
                words += part.split(" ")[overlap:]
            assert " ".join(words) == text


def test_filter_strings(evaluate):
    rows = [("./a%20b/\n\n  \n c+d \n%zz",), ("",)]
    assert evaluate(t.parse_filter_string, rows, "s string") == [["./a b/", " c+d ", "%zz"], []]


def test_dir_patterns(evaluate):
    rows = [("./.git/",), ("./node_modules/",), ("a/b",), ("./",), (".venv",)]
    assert evaluate(t.clean_dir_pattern, rows, "s string") == ["git", "node_modules", "a/b", "", "venv"]


def test_redaction(evaluate):
    secrets = ["s3cr+t/=*~ x", "", None, "abc"]
    rows = [(f"raw {s} enc {urllib.parse.quote(s or '', safe='')} end", s) for s in secrets]
    want = []
    for text, s in rows:
        if s:
            text = text.replace(s, "***TOKEN***").replace(urllib.parse.quote(s, safe=""), "***TOKEN***")
        want.append(text)
    assert evaluate(t.redact, rows, "x string, s string") == want


def test_trim_and_blank(evaluate):
    rows = ["  a b \n", "\u00a0x\u3000", "", " \t\n", None]
    want = [None if r is None else r.strip() for r in rows]
    assert evaluate(t.trim_ws, [(r,) for r in rows], "s string") == want
    assert evaluate(t.is_blank, [(r,) for r in rows], "s string") == [not (r or "").strip() for r in rows]


def test_encoder_counter_falls_back(evaluate):
    counter = t.encoder_token_counter("no-such-encoding")
    assert evaluate(counter, [("abcdefgh",), ("",), (None,)], "s string") == [2, 0, None]
