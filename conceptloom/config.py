"""Settings of jobs: database and resource folder from INI files, and presets of co-occurrence."""

from __future__ import annotations

import configparser
from dataclasses import dataclass


@dataclass(frozen=True)
class Database:
    url: str
    driver: str
    user: str
    password: str

    @property
    def properties(self) -> dict[str, str]:
        return {"driver": self.driver, "user": self.user, "password": self.password}


def _defaults(path: str) -> configparser.SectionProxy:
    ini = configparser.ConfigParser()
    if not ini.read(path):
        raise FileNotFoundError(path)
    return ini["DEFAULT"]


def read_database(path: str) -> Database:
    d = _defaults(path)
    return Database(d["base_url"], d["driver"], d["user"], d["password"])


def read_resource_folder(path: str) -> str:
    return _defaults(path)["resource_folder"]


#: Days to either side of an event, by the name of the window they make.
SPAN_PRESETS = {"60": 30, "180": 90, "360": 180}
