import ast
import pathlib

ROOT = pathlib.Path(__file__).parents[1]


def test_the_library_does_without_its_training_data_part():
    for p in (ROOT / "rolloom").rglob("*.py"):
        if "llm" in p.parts:
            continue
        for node in ast.walk(ast.parse(p.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n.split(".") for n in names), p
