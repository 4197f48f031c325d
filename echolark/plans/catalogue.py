"""Every registered query of the acoustic and decision engine, with its SQL twin."""

from echolark.operators import calibration, history, kernels, ladders, learning, neighbours, phonetics, prompts, prototyping, relational, scoring, search, sequences, store
from echolark.streaming import live, sessions, stateful

MODULES = (scoring, relational, sequences, calibration, history, kernels, ladders, learning, neighbours, phonetics, prompts, prototyping, search, sessions, stateful, live, store)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLE_SQL = {k: sql for m in MODULES for k, sql in m.ORACLE_SQL.items()}
