"""The plain versions by whatever way the tests are collected."""

import importlib.util
from pathlib import Path

spec = importlib.util.spec_from_file_location("llm_plain", Path(__file__).with_name("plain.py"))
plain = importlib.util.module_from_spec(spec)
spec.loader.exec_module(plain)
