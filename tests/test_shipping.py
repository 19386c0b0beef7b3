import subprocess
import sys

from pyspark import cloudpickle

from bidweave.functions import html as H
from bidweave.operators import chunks as CH
from bidweave.operators import infer as I
from bidweave.sources import files as S


def test_python_steps_run_where_the_package_is_not_installed(tmp_path):
    steps = [CH._pieces, H._first_region, S._decode, I.hashing_encoder(4)]
    (tmp_path / "steps").write_bytes(cloudpickle.dumps(steps))
    code = """if True:
        import pickle, sys
        pieces, region, decode, encoder = pickle.load(open("steps", "rb"))
        print(list(pieces("a.b", 10, 1)), region("<p id='noticeArea'>x</p>"), decode("文".encode("gbk")) == "文", len(encoder()(["x"])[0]), "bidweave" in sys.modules)
    """
    out = subprocess.run([sys.executable, "-I", "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert out.stdout.strip() == "['a.b'] <p id='noticeArea'>x</p> True 4 False", out.stderr
