"""Names that the registered queries use, checked without running them."""

import builtins
import importlib
import types

import pytest

MODULES = ["models", "relational", "samples", "scalars", "scans"]


def _unknown(code: types.CodeType, known: set[str]) -> set[str]:
    import dis

    loaded = {i.argval for i in dis.get_instructions(code) if i.opname in ("LOAD_GLOBAL", "LOAD_NAME")}
    stored = {i.argval for i in dis.get_instructions(code) if i.opname == "STORE_NAME"}
    inner = [c for c in code.co_consts if isinstance(c, types.CodeType)]
    return (loaded - stored - known).union(*[_unknown(c, known) for c in inner])


@pytest.mark.parametrize("name", MODULES)
def test_every_name_is_defined(name):
    module = importlib.import_module(f"lociq.catalog.{name}")
    with open(module.__file__) as source:
        code = compile(source.read(), module.__file__, "exec")
    assert not _unknown(code, set(vars(module)) | set(dir(builtins)))
