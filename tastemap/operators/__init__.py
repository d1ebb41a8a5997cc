from tastemap.operators.interactions import interactions
from tastemap.operators.popularity import item_popularity, popular_items

__all__ = ["interactions", "item_popularity", "popular_items"]
