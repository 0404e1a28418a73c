import random

import pytest
from pyspark.sql import functions as F

from strandloom.llm.residue import ResidueParameters, find_residue

HEAD = "commit 0123456789abcdef0123456789abcdef01234567\nAuthor: Ann Bee <ann.bee@post.invalid>\nDate:   2022-10-26 02:38:27 +0000\n\n"
DIFF = "\ndiff --git a/x.py b/x.py\nindex 1..2 100644\n--- a/x.py\n+++ b/x.py\n@@ -1 +1 @@\n-{{ name }} $NAME lorem ipsum\n+<title>404 Not Found</title> Please enable JavaScript\n"


def found(spark, texts, **kw):
    df = spark.createDataFrame(list(enumerate(texts)), "unit int, line string")
    return {r["doc"] for r in find_residue(df, "unit", "line", **kw).collect()}


RESIDUE = [
    "    ${title}\n",
    "    [your text]\n",
    "    Fix the cache\n\n    Reviewed-by: {{ reviewer }}\n",
    "    Fix the cache\n\n    Reviewed-by: <<title>>\n",
    "    Ticket: [object Object]\n",
    "    Changed by: undefined\n",
    "    <%= version %>: wip cache\n",
    "    Release @@VERSION@@ of cache\n",
    "    Merge branch '%s' into %s\n",
    "    Fixes #<issue number>\n",
    "    type(scope): subject\n\n    body\n",
    "    # Please write the message for your changes above.\n",
    "    YOUR COMMIT MESSAGE HERE\n",
    "    Content content content.\n",
    "    blah blah blah blah\n",
    "    Lorem ipsum pretium varius lacus alique amet.\n",
    "    fix cache\n\n404 Not Found\n\nThe revision you asked for does not exist.\n",
    '    fix cache\n\n{"error": {"code": 429, "message": "slow down"}}\n',
    "    fix cache\n\n<noscript>Please enable JavaScript to view this diff.</noscript>\n",
]
ORDINARY = [
    "    Mail template: rename {{ name }} to {{ full_name }} in the header\n",
    "    tests: use %s placeholders in ticket queries\n",
    "    Warn if the commit template still has [INSERT ...] in it\n",
    "    Show a notice when scripts are off\n",
    '    Clients saw "502 Bad Gateway" in the meantime and gave up.\n',
    "    Replace lorem ipsum on the queue page with the final copy\n",
    "    [queue] Cache the schema\n",
    "    chore(release): 3.8.9 [skip ci]\n",
    "    guard allocator scheduler\n\n    Signed-off-by: Ann Bee <ann.bee@post.invalid>\n",
    "    Conflicts:\n\tsrc/a.py\n",
    "    No behaviour change is meant for callers of x().\n",
]


@pytest.mark.parametrize("text", RESIDUE)
def test_residue(spark, text):
    assert found(spark, [HEAD + text + DIFF, HEAD + "    fix cache\n" + DIFF]) == {0}


def test_ordinary(spark):
    assert found(spark, [HEAD + t + DIFF for t in ORDINARY] + [HEAD.replace("\n", "\r\n") + t for t in ORDINARY]) == set()


def test_slots_are_aligned_over_records(spark):
    # a full sentence with a place: several notations make it a template, one alone is speech about it
    say = "    This was done for the release manager of the day called {} over there\n"
    assert found(spark, [HEAD + say.format(x) for x in ("${a}", "{{ a }}", "Ann")]) == {0, 1}
    assert found(spark, [HEAD + say.format(x) for x in ("${a}", "${b}", "Ann")]) == set()


def test_page_lines_are_induced(spark):
    page = "Nothing to be seen in this place today\n"
    whole = [page + f"\nRequest {i}\n" for i in range(9)]
    inside = [HEAD + "    fix cache\n\n" + page]
    assert found(spark, [*whole, *inside, HEAD + "    fix it\n" + DIFF]) == set(range(10))
    # copies of one record don't make a page
    df = spark.createDataFrame([(i, page, "r") for i in range(9)], "doc int, text string, repo string")
    assert find_residue(df, "doc", "text", "repo").count() == 0


def test_edges(spark):
    assert found(spark, [None, "", "   \n", "\r\n", DIFF]) == set()
    assert found(spark, [HEAD + "    fix cache\n" + DIFF * 5000 + "x" * 200000]) == set()
    df = spark.createDataFrame([(None, "    ${title}\n"), (1, "    ${title}\n"), (1, "    ${title}\n")], "doc int, text string")
    assert [r["doc"] for r in find_residue(df, "doc", "text").collect()] == [1]
    assert find_residue(df.limit(0), "doc", "text").count() == 0


def test_one_line_pages_that_occur_once(spark):
    pages = ["403 Forbidden You don't have permission to view this repository.", "404 not found The log of this place is gone.", "La révision demandée n'existe pas."]
    assert found(spark, [*pages, HEAD + "    404 Not Found is sent for unknown heads\n" + DIFF]) == {0, 1, 2}


def test_pages_repeated_within_one_origin(spark):
    page = "Nothing to be seen in this place today\n"
    df = spark.createDataFrame([(i, page, "r", f"t{i}") for i in range(9)] + [(9, page, "r", None)], "doc int, text string, repo string, time string")
    assert find_residue(df, "doc", "text", "repo", marks=["time"]).count() == 10
    # copies of one commit stay one record
    assert find_residue(df.withColumn("time", F.lit("t")), "doc", "text", "repo", marks=["time"]).count() == 0


def test_identifiers_are_one_word(spark):
    assert found(spark, [HEAD + "    Release @@VERSION@@ of footer_checkpoint\n" + DIFF]) == {0}


def test_slots_are_known_from_their_fillings(spark):
    say = "    This was done for the release manager of the day called {} over in {}\n"
    names = [say.format(*x) for x in (("Ann", "Rome"), ("Bob", "Oslo"), ("Cid", "Bonn"))]
    left = [say.format(*x) for x in (("${a}", "Kyiv"), ("¤name¤", "Lima"), ("RELEASE_MANAGER", "Bern"), ("undefined", "Nice"), ("____", "Cork"))]
    assert found(spark, [HEAD + x for x in names + left]) == {3, 4, 5, 6, 7}
    assert found(spark, [HEAD + x for x in names[:2] + left[1:2]]) == set()


INDUCED = ResidueParameters(known=False, instructions=False)


def corpus():
    """Ordinary commits of few words, and a page in words that no list has: whole, after a message, and in its place."""
    r = random.Random(5)
    nouns, verbs = ["cache", "pool", "route", "frame", "cell", "probe"], ["fix", "move", "split", "guard"]
    say = lambda: f"{r.choice(verbs)} the {r.choice(nouns)} of the {r.choice(nouns)} so that it is read once"
    plain = [HEAD + f"    {say()}\n\n    {say()}\n" + DIFF for _ in range(200)]
    page = "Sivun hakeminen epäonnistui tänään\nKoeta uudelleen iltapäivällä\n"
    whole = [page + f"Kohde {i}\n" for i in range(8)]
    after = [HEAD + f"    {say()}\n\n{page}" for _ in range(4)]
    instead = [HEAD + "    Koeta uudelleen iltapäivällä\n" + DIFF for _ in range(4)]
    filler = ["".join(r.choice(["vesi", "kivi", "puu", "talo", "joki", "tuli"]) + " " for _ in range(9)) + "\n" for _ in range(12)]
    mixed = [HEAD + "    " + "".join(r.choice(["vesi", "kivi", "puu", "talo", "joki", "tuli"]) + " " for _ in range(9)) + "\n" + DIFF for _ in range(4)]
    return plain, whole + after + instead + filler + mixed


def test_pages_and_filler_are_induced_from_the_records_alone(spark):
    plain, pages = corpus()
    assert found(spark, plain + pages, parameters=INDUCED) == set(range(len(plain), len(plain + pages)))
    assert found(spark, plain + pages, parameters=ResidueParameters(known=False, instructions=False, pages=False)) == set()


def test_a_page_within_one_message_only_is_no_page(spark):
    plain, _ = corpus()
    say = HEAD + "    Sivun hakeminen epäonnistui tänään\n" + DIFF
    assert found(spark, [*plain, *[say] * 8], parameters=INDUCED) == set()


def test_gibberish(spark):
    plain, _ = corpus()
    assert found(spark, [*plain * 3, HEAD + "    qwpe xcvk jhgt rtyu zmnq lkpw\n" + DIFF], parameters=INDUCED) == {len(plain) * 3}
    # in a small table that words occur nowhere else says nothing
    assert found(spark, [HEAD + "    these are words that occur once\n" + DIFF], parameters=INDUCED) == set()


def test_long_places_and_one_repeated_word(spark):
    long = "your " + "very " * 40 + "long text"
    assert found(spark, [HEAD + f"    [{long}]\n" + DIFF, HEAD + "    zap zap zap zap\n" + DIFF, HEAD + "    fix cache\n" + DIFF], parameters=INDUCED) == {0, 1}
