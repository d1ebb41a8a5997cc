from tastemap.plans.registered import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
