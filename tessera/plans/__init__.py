"""The registered queries; importing the package registers them all."""

import importlib

MODULES: tuple[str, ...] = ("aggregates", "relational", "texts", "ranking", "graphs", "streams", "evidence", "content", "mail", "library", "cases", "retrieval", "episodes", "artifacts", "identities", "sections", "bridging")

for _module in MODULES:
    importlib.import_module(f"tessera.plans.{_module}")
