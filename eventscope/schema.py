"""Canonical event schema and the fixed vocabularies of the event model.

One canonical shape ("v2 + context") is used everywhere; the older shapes are
mapped onto it by ``eventscope.operators.normalize``.
"""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values (must equal the modelled application's; do not edit) -------
# Field order of a product record, also used for positional product lists.
PRODUCT_FIELDS = ["product_id", "product_category", "price", "product_type", "brand"]
# Event types of the current producer.
EVENT_TYPES = ["view_product", "add_to_cart", "purchase", "search", "login", "logout"]
# Event types without products.
NO_PRODUCT_EVENT_TYPES = ["login", "logout"]
DEVICES = ["Mobile", "Desktop", "Tablet"]
USER_TYPES = ["new", "returning"]
# Product taxonomy of the current producer.
CATEGORIES = ["Electronics", "Fashion", "Home", "Books", "Beauty", "Toys", "Grocery",
              "Furniture", "Sports and Fitness"]
PRODUCT_TYPES = {
    "Electronics": ["Smartphone", "Laptop", "Camera"],
    "Fashion": ["Shoes", "Shirt", "Dress"],
}
BRANDS = {
    "Electronics": ["Apple", "Samsung", "Sony"],
    "Fashion": ["Nike", "Zara", "Puma"],
}
# Wider product taxonomy of the extended producer.
EXTENDED_CATEGORIES = ["Electronics", "Fashion", "Home", "Books", "Beauty", "Toys", "Grocery",
                       "Furniture", "Sports and Fitness", "Automotive", "Pet Supplies"]
EXTENDED_PRODUCT_TYPES = {
    "Electronics": ["Smartphone", "Laptop", "Tablet", "Headphones", "Smartwatch", "Television"],
    "Fashion": ["Shoes", "Shirt", "Dress", "Jeans", "Jacket", "Sunglasses"],
    "Home": ["Bedsheet", "Lamp", "Curtains", "Mattress", "Cookware", "Carpet"],
    "Books": ["Fiction", "Non-Fiction", "Comics", "Textbook", "Biography"],
    "Beauty": ["Lipstick", "Foundation", "Eyeliner", "Perfume", "Skincare Cream"],
    "Toys": ["Action Figure", "Puzzle", "Doll", "Board Game", "Lego Set"],
    "Grocery": ["Rice", "Pasta", "Milk", "Snacks", "Juice", "Spices"],
    "Furniture": ["Sofa", "Dining Table", "Chair", "Bookshelf", "Bed"],
    "Sports and Fitness": ["Treadmill", "Dumbbells", "Yoga Mat", "Cycle", "Tennis Racket"],
    "Automotive": ["Car Battery", "Tyre", "Car Vacuum", "Air Freshener"],
    "Pet Supplies": ["Dog Food", "Cat Litter", "Pet Shampoo", "Pet Toy"],
}
EXTENDED_BRANDS = {
    "Electronics": ["Apple", "Samsung", "Sony", "Dell", "Lenovo", "LG"],
    "Fashion": ["Nike", "Zara", "Puma", "Adidas", "H&M", "Levi's"],
    "Home": ["Philips", "Prestige", "Usha", "Cello", "Milton"],
    "Books": ["Penguin", "HarperCollins", "Scholastic", "Bloomsbury"],
    "Beauty": ["L'Oreal", "Maybelline", "Lakme", "Nivea", "The Body Shop"],
    "Toys": ["Lego", "Barbie", "Hot Wheels", "Funskool", "Fisher-Price"],
    "Grocery": ["Nestle", "Amul", "Patanjali", "Tata", "Aashirvaad"],
    "Furniture": ["Ikea", "Godrej", "Urban Ladder", "Pepperfry"],
    "Sports and Fitness": ["Decathlon", "Nike", "Adidas", "Reebok"],
    "Automotive": ["Bosch", "Michelin", "Goodyear", "3M"],
    "Pet Supplies": ["Pedigree", "Whiskas", "Drools", "Himalaya"],
}
# Value formats of the producers.
EVENT_ID_PATTERN = r"^U[0-9]{4}$"
PRODUCT_ID_PATTERN = r"^P[0-9]{3}$"
PRICE_PATTERN = r"^\$[0-9]+$"
# Journey classes, first match wins.
JOURNEY_COMPLETED = "Completed Purchase"
JOURNEY_ABANDONED = "Abandoned Cart"
JOURNEY_BROWSING = "Browsing Only"
JOURNEY_OTHER = "Other"
# Defaults for absent columns / categories.
UNKNOWN_ID = "unknown"
UNKNOWN_CATEGORY = "Unknown"
# Kafka topic of the ingest job.
DEFAULT_TOPIC = "test-events"
# ------------------------------------------------------------------------------

PRODUCT_TYPE = T.StructType([T.StructField(f, T.StringType(), True) for f in PRODUCT_FIELDS])
PRODUCTS_TYPE = T.ArrayType(PRODUCT_TYPE, True)

# What the ingest job parses from the topic ("v2").
EVENT_SCHEMA = T.StructType([
    T.StructField("event_id", T.StringType(), True),
    T.StructField("event_type", T.StringType(), True),
    T.StructField("timestamp", T.DoubleType(), True),
    T.StructField("products", PRODUCTS_TYPE, True),
])

# The wide reader schema ("v2 + context").
CONTEXT_FIELDS = ["ip", "device", "user_type"]
EVENT_LOG_SCHEMA = T.StructType(
    EVENT_SCHEMA.fields[:3]
    + [T.StructField(c, T.StringType(), True) for c in CONTEXT_FIELDS]
    + EVENT_SCHEMA.fields[3:]
)
