"""python -m lodestone DATA_DIR [--project PATH]: the registry of an index as JSON."""

from __future__ import annotations

import argparse
import json

from lodestone.engine import Engine
from lodestone.session import local_session


def main() -> None:
    p = argparse.ArgumentParser(prog="lodestone", description=__doc__)
    p.add_argument("data_dir")
    p.add_argument("--project")
    a = p.parse_args()
    print(json.dumps(Engine(local_session(2, 4, "1g"), a.data_dir).registry(a.project), indent=2))


if __name__ == "__main__":
    main()
