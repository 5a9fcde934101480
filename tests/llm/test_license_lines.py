"""The licence scan reaches lines that hold no cue word."""

import pytest

from loomline.llm import license_scan
from loomline.llm._shared import table


@pytest.fixture(scope="module")
def model(spark, sf_dir):
    return license_scan.train(table(spark, "documents")(sf_dir))


def test_all_notices_are_known(model):
    for family, notices in license_scan.NOTICES.items():
        for n in notices:
            assert [f for _, f, _ in model.scan([f"Some words.\n{n}\nMore".encode()])[0]] == [family], n


def test_lines_without_cue_words(model):
    assert [(n, f) for n, f, _ in model.scan([b"x\nDistributed under MPL 2.0"])[0]] == [(1, "mpl-2.0")]
    assert model.scan([b"", b"no cue here", b"the and of\n\n?!"]) == [[], [], []]


def test_notices_in_the_sample_do_not_teach_none(model):
    notice = "Released under the GNU GPL v2."
    taught = license_scan.Classifier([notice] * 200 + [f"plain line {i} of the text" for i in range(200)])
    assert [f for _, f, _ in taught.scan([notice.encode()])[0]] == ["gpl-2.0"]
