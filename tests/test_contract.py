"""The rest of the library must work without the optional sub-package."""

import pathlib
import re

ROOT = pathlib.Path(__file__).parent.parent


def test_nothing_imports_the_optional_package():
    for p in (ROOT / "memlake").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT / "memlake").parts:
            assert not re.search(r"memlake\.llm|from memlake import llm", p.read_text()), p


def test_no_local_checkpoints():
    for p in (ROOT / "memlake").rglob("*.py"):
        assert ".localCheckpoint(" not in p.read_text()
