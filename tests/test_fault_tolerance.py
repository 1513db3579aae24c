import os
import subprocess
import sys


def test_exact_results_under_task_retries():
    script = os.path.join(os.path.dirname(__file__), "fault_injection_job.py")
    out = subprocess.run([sys.executable, script], capture_output=True, text=True, timeout=600)
    assert "FAULT-INJECTION-OK" in out.stdout, out.stdout[-2000:] + out.stderr[-3000:]
