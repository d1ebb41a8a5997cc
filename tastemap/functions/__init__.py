from tastemap.functions.ranking import top_k

__all__ = ["top_k"]
