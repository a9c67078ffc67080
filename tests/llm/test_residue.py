import pytest

from sondewerk.llm import residue
from tests.conftest import rows

LONG = "The night crew cleaned the contact face and wrote down 0.6 as the new kurtosis of the pump. " * 5

BAD = {
    "field": ["Dear {{ first_name }}, thank you.", "Report for ${SITE} is done. " + LONG, "Summary\n\n[Your name here]", "Node <<threshold>> is up. " + LONG, "Value: XX.XX", "Call %%STATION%% now", "<bitte ausfüllen>", "TBD TBD TBD", "{0} was measured", "By __AUTHOR__.", "[[date]]", "$node_label$ is late"],
    "filler": ["Lorem ipsum dolor sit amet, consectetur.", LONG + "\n\ntempor incididunt ut labore et dolore magna aliqua", "Dies ist ein Blindtext.", "Your headline here", "text text text text text", "xxxx xxxx xxx xxxx."],
    "error": ["404 Not Found", "<html><body><h1>502 Bad Gateway</h1></body></html>", "# Run report 9\n\nMenu | Nodes | Help\n\nError 503: Service temporarily unavailable.\n\nImprint | Contact", "Traceback (most recent call last):\n  File \"a.py\", line 3", "Seite nicht gefunden.", "THIS CONTENT IS NO LONGER AVAILABLE."],
    "notice": ["Please enable JavaScript to view this page.", "<noscript>You need to enable JavaScript to run this app.</noscript>", "Your session has expired. Please sign in again to continue.", "Für diese Ansicht muss JavaScript aktiviert sein.", "Checking your browser before opening the viewer."],
}
GOOD = [
    LONG, "The generator renders `{{ verdict }}` from the receipt.", "```\nprint(f\"{x}\")\nHOME=${HOME}\n```\nThat sets the folder.", "The old template began with lorem ipsum; we replaced it.", LONG + "A 502 during the poll counts as one step.",
    "Our test checks that a page saying 'Service Unavailable' is never stored.", "We dropped the viewer since it needs JavaScript. " + LONG, "In the formula x_{i+1} = r x_{i} (1 - x_{i}) the index i counts.", "The TODO list is empty: all is done.", '{"claim": "x", "auc": 0.5}', "The class has an __init__ method.", "It cost $5 and then $7.",
]


@pytest.mark.parametrize("kind", BAD)
def test_residue_is_found(kind):
    assert [residue.kind_of(t) for t in BAD[kind]] == [kind] * len(BAD[kind])


def test_content_is_left_alone():
    assert [residue.kind_of(t) for t in GOOD] == [None] * len(GOOD)
    assert [residue.kind_of(t) for t in (None, "", "  \n")] == [None] * 3


def test_whole_table(spark):
    data = [(1, "404 Not Found", "k"), (2, None, "k"), (3, "", "k"), (4, LONG * 2000 + " {{ name }}", "k"), (5, LONG, "k"), (5, LONG, "k"), (None, "404 Not Found", "k"), (1, "404 Not Found", "k")]
    df = spark.createDataFrame(data, "doc_id bigint, text string, kind string")
    assert {tuple(r) for r in rows(residue.residue(df))} == {(1, "error"), (4, "field")}
    assert sorted(r.doc_id or 0 for r in residue.without_residue(df).collect()) == [0, 2, 3, 5, 5]
    assert rows(residue.residue(df.limit(0))) == []


def test_pretests_let_the_whole_grammar_pass():
    dates = ["DATE", "NAME", "TITLE", "DATUM", "TITEL", "COMPANY", "FIRMA", "AUTHOR", "LOCATION", "ORT", "TT.MM.JJJJ", "DD/MM/YYYY", "DD.MM.YYYY", "YYYY-MM-DD"]
    asked = ["todo", "tbd", "fixme", "insert", "enter", "fill in", "your", "add", "replace", "choose", "bitte", "hier", "name der", "eintragen", "einfügen", "einsetzen", "ihr", "ihren", "platzhalter", "placeholder"]
    other = ["{{ a }}", "{% if %}", "${ a }", "#{ a }", "{0}", "{}", "%%A B%%", "%NAME%", "@@a@@", "<<a>>", "<%= a %>", "[[a]]", "__AB__", "$ab$", "« a »", "*|A|*", "TBD TBD", "TODO, TODO", "XXX XXX", "FIXME FIXME", "N.N. N.N.", "XX.XX", "????", "____"]
    for t in [*(f"[{d}]" for d in dates), *(f"{o}{w} x{c}" for w in asked for o, c in ("[]", "<>", "()")), *other]:
        assert residue.kind_of(f"Date: {t}") == "field", t
    ask = [f"{a} {b}{c} {h}" for a in ("your", "ihr", "ihre") for b in ("", "sub") for c in ("headline", "heading", "title", "text", "content", "überschrift", "titel") for h in ("goes here", "here", "hier")]
    said = [f"this is a {k} {n}" for k in ("placeholder", "dummy", "sample", "filler") for n in ("paragraph", "text", "copy", "content")] + [f"{a} will be {b} before release" for a in ("text", "copy") for b in ("removed", "replaced")]
    keys = [" ".join([w] * 4) for w in ("asdf", "qwer", "qwertz", "yxcv", "zxcv", "jkl", "test", "foo", "bar", "bla", "xyz", "abc")]
    rest = ["lorem ipsum dolor", "dies ist ein blindtext", "dies ist ein platzhalter", "hier steht beispieltext", "er hat keinen inhalt und füllt nur den platz", "replace this sentence with", "tap to add subtitle", "click here to edit text", "ersetzen sie diesen absatz", "text text text text", "insert text here", "the quick brown fox jumps over the lazy dog", "xxx xxx xxx"]
    for t in [*ask, *said, *keys, *rest]:
        assert residue.kind_of(t) == "filler", t


def test_the_whole_message_counts_as_message():
    frames = "".join(f"  File \"/srv/app/step{i}.py\", line {i}, in run\n    value = table[step.name_of(node)]\n" for i in range(6))
    trace = "Traceback (most recent call last):\n" + frames + "KeyError: 'node'"
    java = "Exception in thread \"main\" java.lang.IllegalStateException: closed\n" + "".join(f"\tat com.example.poll.Step{i}.run(Step{i}.java:{i})\n" for i in range(9)) + "Caused by: java.io.IOException: broken pipe\n\t... 9 more"
    wrapped = "503 Service Unavailable\n" + "The server is busy with the maintenance of its storage\nand cannot answer at the moment.\n" * 3
    signed = "Please sign in to continue.\n" + "Reports of this station are kept for its members,\nwho find the key in their letter.\n" * 4
    flat = "\n".join(x.strip() for x in trace.split("\n"))
    for text in (trace, flat, trace + "\n\nDuring handling of the above exception, another exception occurred:\n\n" + trace, java, "# Report 7\n\n" + trace + "\n\nImprint | Contact", wrapped):
        assert residue.kind_of(text) == "error", text
    assert residue.kind_of(signed) == "notice"
    # who tells of an error is left alone
    for text in (trace + "\n" + LONG, trace + "\n\n" + LONG, LONG + "\n\n" + wrapped, "Log of the night\nError 503: no answer\n" + "12:05 the poller was started again by hand\n" * 9, "502 Bad Gateway\n" + "- the poller was started again by hand\n" * 9):
        assert residue.kind_of(text) is None, text


def test_context_and_density_of_fields():
    opened = ["The customer named {{name}} will arrive on {{date}} at the site. " + LONG, "The topic is ${project} and the date is ${date}.", "Dear [Customer Name], your order [Order No] has shipped.", "The variable costs are {{amount}} EUR.", "It is called {{ title }} here."]
    assert [residue.kind_of(t) for t in opened] == ["field"] * len(opened)
    spoken = [
        "To show the name, write this:\n\n    Dear {{ name }},\n    on {{ date }}\n\nThe generator does the rest.", "A field called {{ name }} is filled at night.", "For example {{ name }} is filled at night.", "The syntax {{ name }} is that of the old generator.",
        "In the regex \\w{0} the count is zero.", "See [Customer Name](https://example.org) for more.", "Do in it as id ad ex et sit in do id ad.",
    ]
    assert [residue.kind_of(t) for t in spoken] == [None] * len(spoken)
    assert residue.kind_of("The note stands for itself.\n\n    Dear {{ name }},") == "field"


def test_a_single_run_of_filler_amid_a_long_text():
    assert residue.kind_of(LONG * 50 + "\nExcepteur sint occaecat cupidatat non proident.\n" + LONG * 50) == "filler"
    assert residue.kind_of("İ" * 40 + " " + LONG + "lorem ipsum dolor sit amet") == "filler"
