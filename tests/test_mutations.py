import ast

from structura.sources import mutations as M

FILES = {
    "ports.py": "from abc import ABC, abstractmethod\n\nclass Store(ABC):\n    @abstractmethod\n    def save(self, row): ...\n",
    "memory.py": "from ports import Store\n\n_LIMIT = 3\n\nclass Memory(Store):\n    def __init__(self):\n        self._rows = []\n        self.names = {}\n    def save(self, row):\n        self._rows.append(row)\n        return len(self._rows)\n",
    "service.py": "from ports import Store\n\nclass Service:\n    def __init__(self, memory, store: Store):\n        self.memory = memory\n        self.store = store\n    def run(self, row):\n        self.log(row)\n        return self.store.save(row)\n    def log(self, row):\n        pass\n\ndef use(memory):\n    return memory.save(1)\n",
    "broken.py": "def (:\n",
}


def test_every_operator_makes_python(spark):
    found = list(M.mutants(FILES))
    assert {m["operator"] for m in found} == set(M.OPERATORS)
    for m in found:
        assert ast.unparse(ast.parse(m["text"])) != ast.unparse(ast.parse(FILES[m["path"]]))
    assert len({m["mutant"] for m in found}) == len(found) and found == list(M.mutants(FILES))
    assert {m["path"] for m in found} <= set(FILES) - {"broken.py"}


def one(name):
    return {(m["path"], m["what"]): m["text"] for m in M.mutants(FILES, [name])}


def test_what_some_operators_do():
    assert "import memory" in one("add_import")[("ports.py", "memory")] and ("service.py", "ports") not in one("add_import")
    assert "class Memory:" in one("drop_base")[("memory.py", "Memory(Store)")]
    assert "abstractmethod\n    def" not in one("concretize_base")[("ports.py", "Store")]
    assert "def save_renamed" in one("break_port")[("memory.py", "Memory.save")]
    assert "type(memory)()" in one("rebuild_injected")[("service.py", "Service.memory")]
    hard = one("hardcode_collaborator")[("service.py", "Service.memory = Memory()")]
    assert "self.memory = Memory()" in hard and "from memory import Memory" in hard
    assert "return None" in one("stub_role_call")[("service.py", "self.store.save")]
    assert "self.log(row)" not in one("drop_call")[("service.py", "self.log")]
    assert "memory._rows.clear()" in one("mutate_private_container")[("service.py", "Memory._rows")] and "memory.names.clear()" in one("mutate_public_container")[("service.py", "Memory.names")]
    assert "_ = memory._rows" in one("read_private_attribute")[("service.py", "Memory._rows")]


def test_generate(spark):
    rows = [(p, k, v) for p in ("a", "b") for k, v in FILES.items()]
    files = spark.createDataFrame(rows, "project string, path string, text string")
    got = M.generate(files, ["drop_base", "add_library"])
    assert sorted((r.project, r.mutant) for r in got.collect()) == sorted((p, m["mutant"]) for p in ("a", "b") for m in M.mutants(FILES, ["drop_base", "add_library"]))
    targets = M.as_targets(files, got.where("operator = 'drop_base' and project = 'a'")).collect()
    assert len(targets) == len(FILES) and sum("class Memory:" in r.text for r in targets) == 1
    assert [(r.project, r.path) for r in M.skipped(files.withColumn("role", files.project)).orderBy("project").collect()] == [("a", "broken.py"), ("b", "broken.py")]
