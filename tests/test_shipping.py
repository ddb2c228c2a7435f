"""Functions sent to Python workers must not need the package there."""

import base64
import subprocess
import sys

from pyspark import cloudpickle

from debatelens.operators.models import predict_rows
from debatelens.sources.fixtures import hash_predictor


def test_functions_travel_without_the_package(tmp_path):
    def work():
        return predict_rows(hash_predictor("toxicity"), ["a", None], None)

    sent = base64.b64encode(cloudpickle.dumps(work)).decode()
    code = f"import base64, pickle; print(pickle.loads(base64.b64decode('{sent}'))())"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=60)
    assert done.stdout.strip() == repr(work()), done.stderr[-500:]
