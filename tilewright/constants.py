"""Word lists, pools, thresholds and text formats.

Everything in this module is data that results depend on literally. It is kept
together, as plain text and in natural order; no logic lives here.
"""

# ---------------------------------------------------------------- fixed values

# Folders whose images are scene backgrounds.
BACKGROUND_MARKERS = ["/landscapes/", "/landscape/", "/backgrounds/", "/background/"]

# Phrases that captions must not start with.
META_OPENERS = [
    "the image consists of",
    "the image shows",
    "the image depicts",
    "the image features",
    "this image shows",
    "this image depicts",
    "this photograph shows",
    "the photograph shows",
    "the picture shows",
    "this picture shows",
    "the scene shows",
    "the scene depicts",
]
# Characters dropped after such a phrase (inside a regex class).
OPENER_TRAILERS = r" \t\n\r:–—\-•"
CAPTION_WORD_SLACK = 15

# Image suffixes: archive members, caption inputs, depth inputs and depth outputs.
MEMBER_SUFFIXES = [".jpg", ".jpeg", ".png", ".webp", ".bmp", ".gif", ".tiff", ".tif"]
CAPTION_INPUT_SUFFIXES = [".jpg", ".jpeg", ".png", ".webp", ".bmp", ".gif"]
DEPTH_INPUT_SUFFIXES = [".png", ".jpg", ".jpeg", ".webp", ".bmp", ".tif", ".tiff"]
DEPTH_ASSET_SUFFIXES = [".png", ".jpg", ".jpeg", ".webp", ".tif", ".tiff"]

# Layout of one dataset root.
ROOT_DETECTIONS = "bbox_results/yolo26_detections.csv"
ROOT_IMAGES = "images"
ROOT_DEPTH = "depth"
ROOT_CAPTIONS = "image_captions"
ROOT_MULTIVIEW = "multiview_out"

# Boxes and canvases.
CANVAS_WIDTH = 1920
CANVAS_HEIGHT = 1080
TARGET_WIDTH = 1280
TARGET_HEIGHT = 720
LARGE_SIDE = 200.0
MIN_CROP_SIDE = 8
SIDE_PERCENTILES = [0.05, 0.25, 0.50, 0.75, 0.95, 0.99]
SIDE_BIN_EDGES = [0, 50, 100, 150, 200, 250, 300, 400]
SIDE_BIN_LABELS = [
    "<=0", "(0,50]", "(50,100]", "(100,150]", "(150,200]", "(200,250]", "(250,300]", "(300,400]", ">400",
]

# Matching.
RATIO_LIMIT = 0.75
MAX_MATCHES = 50
INLIER_LIMIT_PX = 8.0
SCALE_TOLERANCE = 0.30
MIN_INLIERS = 12
MIN_HYPOTHESES = 200
MAX_HYPOTHESES = 4000
HYPOTHESES_PER_POINT = 20

# Reference composition.
LANDSCAPE_CATEGORY = "landmark"
PERSON_CATEGORY = "person"
MAX_PERSON_REFS = 1
SAME_CATEGORY_PROB = 0.15
REF_COUNT_WEIGHTS = {2: 0.5, 3: 0.5}
LANDSCAPE_TAG = " (LANDSCAPE/ENVIRONMENT)"
REFERENCE_LEAD = "{number}. [{category}]{tag} "  # stands before a reference's caption

# Composition conditions: (key, instruction).
SCALES = [
    ("natural_scale", "all subjects appear at their natural, real-world relative scale to one another"),
    ("hero_scale_up", "the first-listed subject is scaled up dramatically, dominating the frame compared to the others"),
    ("miniature", "the whole scene appears miniaturized, like a diorama or tilt-shift photograph"),
    ("extreme_closeup", "extreme close-up framing that fills most of the frame with fine surface detail"),
    ("wide_shot", "a wide establishing shot where the subjects appear small within a much larger environment"),
]
ROTATIONS = [
    ("front_facing", "subjects are shown front-facing, directly toward the camera"),
    ("three_quarter", "subjects are shown at a three-quarter angle"),
    ("profile", "subjects are shown in profile view, seen from the side"),
    ("low_angle", "the shot is taken from a low angle looking upward, emphasizing height and scale"),
    ("high_angle", "the shot is taken from a high angle looking downward, a bird's-eye perspective"),
    ("dutch_angle", "the camera is tilted at a dutch angle for a dynamic, off-kilter composition"),
    ("from_behind", "subjects are shown from behind or a rear three-quarter view"),
]
LIGHTINGS = [
    ("golden_hour", "warm golden-hour sunlight casting long, soft shadows"),
    ("harsh_noon", "harsh overhead midday sunlight with hard-edged shadows"),
    ("studio_softbox", "even, diffused studio softbox lighting with minimal shadow"),
    ("neon_night", "moody neon-lit night-time lighting with saturated colored highlights"),
    ("overcast", "soft, overcast diffuse daylight with flat, even illumination"),
    ("candlelight", "warm, flickering candlelight with deep ambient shadow"),
    ("moonlight", "cool blue moonlight with low ambient light"),
    ("rim_light", "dramatic rim lighting separating the subjects from a darker background"),
]
INTERACTIONS = [
    ("holding", "one subject is actively holding, touching, or carrying another element in the scene"),
    ("side_by_side", "the subjects are positioned side by side, coexisting in the same space without direct contact"),
    ("using_object", "a subject is actively using or functionally interacting with an object present in the scene"),
    ("approaching", "one subject is walking toward or approaching another across the scene"),
    ("presenting", "a subject is gesturing toward or presenting another element in the frame"),
    ("consuming", "a subject is in the act of eating or tasting food present in the scene"),
    ("backdrop", "one element (such as a landmark) serves purely as a backdrop behind the other subject(s), with no direct interaction"),
]
COMPOSITION_TEMPLATE = """You are writing a single combined image-generation prompt that will guide a diffusion model to compose ONE new scene using {n} reference subjects together.

Reference #1 below is the LANDSCAPE / ENVIRONMENT reference — it sets the location and setting of the entire scene. It is NOT a subject to place into the scene; everything else is placed INTO it.
The remaining reference(s) are the SUBJECTS to be placed within that landscape.

References (factual descriptions — each one corresponds to a separate input reference image):
{reference_block}

Write ONE cohesive, cinematic scene description (60-100 words) that:
- Uses the landscape reference (#1) as the setting/environment of the whole scene — describe the place itself, grounded in its real features
- Places ALL other reference subjects into that landscape together, in a single unified scene
- Follows these exact composition constraints:
  - Scale: {scale_instruction}
  - Camera angle: {rotation_instruction}
  - Lighting: {lighting_instruction}
  - Interaction: {interaction_instruction}
- Keeps each subject's identity and appearance consistent with its reference description above — only change HOW it is composed into the new scene, never WHAT it looks like
- Is written as a single flowing paragraph, vivid and cinematic, suitable to be used directly as an image-generation prompt
- Does NOT use meta-language like "reference image", "combine", "subject 1", or similar — describe the final target scene directly, as if narrating what the camera sees

Respond with ONLY the combined scene description text. No preamble, no labels, no quotation marks.
"""

# Multi-reference generation prompt.
MANY_REFS_HEADER = "Reference images:"
MANY_REFS_CLOSING = (
    "Combine these references into a single unified, photorealistic scene "
    "matching the description above. Preserve the identity, structure, and "
    "distinguishing features of each subject exactly as shown in its "
    "reference image. Do not merge, swap, or blend features between "
    "different reference subjects, and do not depict the references as "
    "separate panels — render one cohesive shot."
)
ONE_REF_HEADER = "Reference image shows: "
ONE_REF_CLOSING = (
    "Preserve the identity and distinguishing features of the subject "
    "exactly as shown in the reference image, composited into the scene "
    "described above."
)

# Group prompt when no row carries one.
SCENE_OF_CLASSES = "A scene containing: "
SCENE_DEFAULT = "A scene image."

# Themes: six co-located objects each.
THEME_OBJECTS = {
    "cozy_kitchen": ["refrigerator", "oven", "sink", "toaster", "bowl", "knife"],
    "dining_room": ["dining table", "wine glass", "bottle", "cup", "fork", "spoon"],
    "living_room": ["couch", "tv", "remote", "vase", "potted plant", "clock"],
    "bedroom": ["bed", "book", "backpack", "cell phone", "teddy bear", "clock"],
    "home_office": ["laptop", "keyboard", "mouse", "chair", "book", "cell phone"],
    "city_street": ["car", "traffic light", "stop sign", "bicycle", "bench", "fire hydrant"],
    "sports_field": ["sports ball", "baseball bat", "baseball glove", "skateboard", "tennis racket", "frisbee"],
    "beach_day": ["surfboard", "kite", "umbrella", "backpack", "bottle", "handbag"],
    "savanna_wildlife": ["elephant", "zebra", "giraffe", "bear", "horse", "cow"],
    "transportation_hub": ["airplane", "bus", "train", "truck", "boat", "motorcycle"],
}
OBJECTS_PER_THEME = 6
THEME_STRIDE = 1_000_003

LOCATIONS = [
    ("foreground_left", "in the immediate foreground, lower-left of frame"),
    ("foreground_right", "in the immediate foreground, lower-right of frame"),
    ("foreground_center", "front and center, closest to camera"),
    ("midground_left", "in the midground, left of center"),
    ("midground_right", "in the midground, right of center"),
    ("midground_center", "in the midground, directly centered"),
    ("background_left", "receding into the background, upper-left"),
    ("background_right", "receding into the background, upper-right"),
    ("background_center", "in the far background, centered and slightly out of focus"),
    ("top_shelf", "resting on a high shelf or ledge near the top of frame"),
    ("floating_midair", "suspended in midair, as if floating"),
    ("bottom_edge", "along the very bottom edge of frame, partially cropped"),
]
SHOT_LABELS = {
    "close_up": "an extreme close-up shot",
    "mid_shot": "a medium shot",
    "wide_shot": "a wide establishing shot",
}
SHOT_CAMERAS = {
    "close_up": (
        "an extreme close-up shot with a shallow depth of field — the camera "
        "sits just inches from the nearest object, which is razor-sharp, while "
        "anything past the mid-ground dissolves into a soft, creamy blur"
    ),
    "mid_shot": (
        "a medium shot, framed like a well-composed tabletop or workspace "
        "still-life — the camera sits a few feet back so every object stays "
        "clearly legible, with only gentle, natural falloff toward the edges"
    ),
    "wide_shot": (
        "a wide establishing shot that takes in the entire room or environment — "
        "deep focus keeps both near and far objects readable across the full "
        "depth of the space"
    ),
}
SHOT_LOCATIONS = {
    "close_up": [
        "foreground_left", "foreground_right", "foreground_center",
        "midground_left", "midground_right", "midground_center", "bottom_edge",
    ],
    "mid_shot": [
        "foreground_left", "foreground_right", "foreground_center",
        "midground_left", "midground_right", "midground_center",
        "top_shelf", "bottom_edge",
    ],
    "wide_shot": [
        "foreground_left", "foreground_right", "foreground_center",
        "midground_left", "midground_right", "midground_center",
        "background_left", "background_right", "background_center",
        "top_shelf", "floating_midair", "bottom_edge",
    ],
}
ORIENTATIONS = [
    ("facing_camera", "facing directly toward the camera"),
    ("profile_left", "turned in left profile"),
    ("profile_right", "turned in right profile"),
    ("three_quarter_left", "angled three-quarters to the left"),
    ("three_quarter_right", "angled three-quarters to the right"),
    ("facing_away", "turned away from the camera, back to the viewer"),
    ("tilted_45", "tilted at a 45-degree angle, as if mid-fall"),
    ("lying_flat", "lying flat on its side"),
    ("upright_vertical", "standing perfectly upright and vertical"),
    ("upside_down", "inverted, upside down"),
    ("leaning", "leaning against a nearby surface"),
    ("mid_motion", "caught mid-motion, slightly blurred with implied movement"),
]
COLORS = [
    "deep crimson", "burnt orange", "emerald green", "midnight blue", "ivory white",
    "charcoal black", "tarnished gold", "dusty rose", "steel gray", "amber",
    "violet", "faded teal", "copper", "bone white", "obsidian black",
]
MATERIALS = [
    "weathered and worn", "polished to a high shine", "rusted and corroded",
    "finely detailed", "matte and understated", "gently glowing",
    "translucent and glassy", "scuffed and well-used", "leather-bound and creased",
    "dust-covered", "freshly cleaned", "chipped and battered",
]
THEME_SETTINGS = {
    "cozy_kitchen": "inside a warm, sunlit farmhouse kitchen with tiled countertops and hanging pots",
    "dining_room": "inside an elegant dining room lit by a low-hanging chandelier",
    "living_room": "inside a cozy living room lit by warm lamplight and the flicker of a television",
    "bedroom": "inside a quiet, softly lit bedroom with rumpled linens and morning light through curtains",
    "home_office": "inside a cluttered home office lit by a desk lamp and a glowing laptop screen",
    "city_street": "along a rain-slicked city street lit by streetlights and passing headlights",
    "sports_field": "on a sunlit outdoor sports field with worn grass and faded chalk lines",
    "beach_day": "on a sun-drenched beach with soft sand and rolling surf in the distance",
    "savanna_wildlife": "across an open golden savanna under a wide, dusty sky",
    "transportation_hub": "inside a bustling transportation terminal with distant announcements and shifting crowds",
}
THEME_SURFACES = {
    "cozy_kitchen": [
        "set on the tiled countertop", "tucked inside the open cabinet",
        "resting on the stovetop", "hanging from a wall hook",
        "set on the wooden cutting board", "tucked into a corner nook by the window",
    ],
    "dining_room": [
        "set at a place setting on the table", "resting beside a folded napkin",
        "set on the side buffet", "placed near the centerpiece",
        "on a woven placemat", "set beside a lit candle at the table's edge",
    ],
    "living_room": [
        "set on the coffee table", "resting on the couch cushions",
        "on a floating wall shelf", "set on the windowsill",
        "beside the TV stand", "set on the area rug",
    ],
    "bedroom": [
        "set on the nightstand", "resting atop the rumpled bedsheets",
        "on the dresser", "propped against a pillow",
        "on the windowsill", "half-tucked under the edge of the bed",
    ],
    "home_office": [
        "set on the cluttered desk", "resting on a stack of papers",
        "beside the laptop", "on a low shelf within arm's reach",
        "set on the desk's armrest", "in a drawer left half-open",
    ],
    "city_street": [
        "parked at the curb", "propped against a lamppost",
        "set on the sidewalk", "near the crosswalk",
        "beside a storm drain", "resting against a brick building wall",
    ],
    "sports_field": [
        "set on the sideline bench", "resting on the worn grass",
        "near the goalpost", "on the chalk line",
        "propped against the chain-link fence", "tucked into an open equipment bag",
    ],
    "beach_day": [
        "half-buried in the sand", "propped against a beach towel",
        "near the water's edge", "resting on a striped blanket",
        "tucked beside a cooler", "planted upright in the sand",
    ],
    "savanna_wildlife": [
        "standing in the tall dry grass", "near a shallow watering hole",
        "beneath the shade of a lone acacia tree", "on a dusty worn trail",
        "at the edge of the herd", "silhouetted against the horizon",
    ],
    "transportation_hub": [
        "parked at the gate", "sitting on the platform",
        "near the boarding ramp", "beside the luggage carousel",
        "idling in its bay", "waiting at the terminal curb",
    ],
}
SURFACE_OVERRIDES = {
    "refrigerator": ["standing against the kitchen wall, door closed", "humming quietly in the corner of the kitchen"],
    "oven": ["built into the counter, door closed", "standing against the far wall, dials glinting"],
    "sink": ["built into the countertop beneath the window", "set into the counter, faucet dripping"],
    "dining table": ["standing at the center of the room, set for a meal", "positioned as the room's centerpiece, linens laid out"],
    "couch": ["positioned against the living room wall", "set as the room's centerpiece seating"],
    "tv": ["mounted on the wall facing the couch", "set atop a low media console"],
    "bed": ["positioned against the bedroom wall, linens rumpled", "set beneath the window, sheets in disarray"],
    "chair": ["pulled up to the desk", "positioned facing the monitor"],
    "traffic light": ["mounted on its post above the intersection", "standing fixed at the corner, lens glowing"],
    "stop sign": ["planted on its post at the corner", "fixed at the edge of the crosswalk"],
    "fire hydrant": ["fixed to the sidewalk at the corner", "standing at the curb's edge"],
    "bench": ["bolted along the sidewalk", "fixed near the crosswalk, paint peeling"],
}
THEME_CHARACTERS = {
    "cozy_kitchen": [
        "a home cook wiping their hands on an apron, glancing toward the stove",
        "a child sneaking a taste from a bowl on the counter",
        "an elderly figure quietly tidying the kitchen before dawn",
    ],
    "dining_room": [
        "a host straightening the table setting before guests arrive",
        "a lone figure seated at the far end of the table, lost in thought",
        "someone refilling a glass in the low chandelier light",
    ],
    "living_room": [
        "a person curled up on the couch, half-lit by the television",
        "a figure standing at the window, watching the evening settle in",
        "someone reaching for the remote without looking up",
    ],
    "bedroom": [
        "a figure just waking, sheets tangled around them",
        "someone sitting on the edge of the bed, phone in hand",
        "a person packing quietly before sunrise",
    ],
    "home_office": [
        "a remote worker hunched over the laptop, coffee gone cold",
        "a figure rubbing tired eyes at the cluttered desk",
        "someone on a late call, papers scattered around them",
    ],
    "city_street": [
        "a pedestrian crossing briskly beneath the traffic light",
        "a cyclist pausing at the corner, checking their phone",
        "a lone figure walking past the bench in the rain",
    ],
    "sports_field": [
        "a player crouched at the sideline, catching their breath",
        "a coach gesturing instructions from the bench",
        "a kid chasing after a rolling ball mid-play",
    ],
    "beach_day": [
        "a surfer waxing their board at the water's edge",
        "a sunbather shading their eyes beneath the umbrella",
        "a child piling up a small mound of sand nearby",
    ],
    "savanna_wildlife": [
        "a lone ranger observing quietly through binoculars from a distance",
        "a guide pointing out the herd to unseen tourists",
        "a photographer crouched low, camera raised toward the horizon",
    ],
    "transportation_hub": [
        "a traveler hurrying toward the gate, bag slung over one shoulder",
        "a conductor pausing near the boarding ramp",
        "a family waiting anxiously near the luggage carousel",
    ],
}
THEME_TEMPLATE = """You are writing a single cinematic image/video generation prompt for a "{theme}" scene, captured as {shot_label}.

Setting: {setting}
Camera & framing: {camera_text}
{character_block}
The scene must contain exactly these {n} objects, each grounded on a real surface with its own location + orientation, exactly as specified (do not add, remove, merge, or relocate any of them, and do not invent extra props):
{structured_block}

Write ONE cohesive, cinematic scene description (70-110 words) that:
- Opens by establishing the setting and this shot's framing / depth of field
- Places each of the {n} objects believably on the physical surface it's grounded to (table, wall, floor, shelf, curb, sand, grass, etc.), preserving its stated color, material/finish, location, and orientation
- {character_instruction}
- Hints at a story or a mood — a sense of who has been here, what just happened, or what's about to happen — rather than reading like a flat inventory list
- Reads as a single flowing paragraph, vivid and cinematic, suitable to be used directly as a photorealistic image/video generation prompt
- Does NOT use meta-language like "the objects are", "positioned at", "reference"
- Does NOT add any props beyond the {n} objects listed{character_object_note}

Respond with ONLY the scene description text. No preamble, no labels, no quotation marks.
"""
CHARACTER_BLOCK = "A human presence is also in frame (not one of the {n} objects): {character}.\n"
CHARACTER_PRESENT = (
    "Weaves the human figure into the scene naturally — their pose, position, and "
    "relationship to the objects should reinforce the story, without ever being described as one of the objects"
)
CHARACTER_ABSENT = "Keeps the scene unpeopled — no human figures, just the environment and the objects"
CHARACTER_NOTE = " (the human figure is scene dressing, not a 7th object)"

# Camera views for re-rendered crops.
AZIMUTHS = [
    "front view", "front-right quarter view", "right side view", "back-right quarter view",
    "back view", "back-left quarter view", "left side view", "front-left quarter view",
]
ELEVATIONS = ["low-angle shot", "eye-level shot", "elevated shot", "high-angle shot"]
DISTANCES = ["close-up", "medium shot", "wide shot"]
IDENTITY_VIEW = ("front view", "eye-level shot", "medium shot")
VIEW_PREFIX = "<sks> "

# Training-input plans.
CAPTION_DROPOUT = 0.1
MIN_RESOLUTION = 512
MAX_RESOLUTION = 1280
SIZE_MULTIPLE = 16
MARGIN_MIN = 10
MARGIN_MAX = 30
MARGIN_EXPAND_PROB = 0.5
BRIGHTNESS_PROB = 0.88
BRIGHTNESS_RANGE = (0.45, 1.85)
BRIGHTNESS_DIM = (0.32, 0.58)
BRIGHTNESS_LIT = (1.42, 2.08)
CONTRAST_PROB = 0.55
CONTRAST_RANGE = (0.78, 1.28)
FLIP_PROB = 0.5
ROTATE_PROB = 0.55
ROTATE_MILD = 8.0
ROTATE_EXTREME = 14.0
SHEAR_PROB = 0.45
SHEAR_MILD = 10.0
SHEAR_EXTREME = 18.0
DEPTH_BLUR_PROB = 0.7
DEPTH_BLUR_KERNELS = [11, 15, 21, 31, 41]
DEPTH_NOISE_PROB = 0.4
DEPTH_NOISE_STD = (0.03, 0.10)
DEPTH_PATCH_PROB = 0.3
DEPTH_PATCH_DROP = 0.3
DEPTH_PATCH_KERNEL = 21

# Model calls.
MODEL_TRIES = 3
