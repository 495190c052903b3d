"""Explicit schemas of the tables; nothing is inferred at read time."""

from __future__ import annotations

REFS = (
    "id string, category string, source_path string, saved_image_path string, saved_metadata_path string, "
    "quality string, reason string, caption string, error string, raw_response string"
)
CONDITIONS = "struct<scale:string,rotation:string,lighting:string,interaction:string>"
COMPOSITIONS = (
    "id string, num_references int, reference_images array<string>, reference_categories array<string>, "
    f"reference_captions array<string>, reference_details array<string>, conditions {CONDITIONS}, "
    "conditions_text struct<scale_instruction:string,rotation_instruction:string,lighting_instruction:string,"
    "interaction_instruction:string>, combined_caption string, error string, dry_run boolean"
)
GENERATED = (
    "id string, num_references int, reference_images array<string>, gen_width int, gen_height int, prompt string, "
    "seed bigint, guidance_scale double, num_inference_steps int, model_id string, output_image string"
)
OBJECT_DETAIL = (
    "struct<object:string,surface_text:string,location_key:string,location_text:string,orientation_key:string,"
    "orientation_text:string,color:string,material:string>"
)
THEME_PROMPTS = (
    "id string, theme string, shot_type string, has_character boolean, character_text string, num_objects int, "
    f"objects array<string>, object_details array<{OBJECT_DETAIL}>, structured_prompt string, "
    "combined_prompt string, error string, dry_run boolean"
)
THEME_IMAGES = (
    "id string, theme string, shot_type string, num_objects int, objects array<string>, "
    f"object_details array<{OBJECT_DETAIL}>, structured_prompt string, prompt string, seed bigint, gen_width int, "
    "gen_height int, guidance_scale double, num_inference_steps int, model_id string, output_image string"
)
BOX = "struct<object:string,found:boolean,label:string,score:double,bbox:array<double>,bbox_norm:array<double>>"
BOXES = (
    "id string, theme string, image_width int, image_height int, "
    f"bbox_information struct<model_id:string,threshold:double,objects:array<{BOX}>>"
)
REFERENCE_IMAGES = (
    "id string, bbox_index int, object string, detected_label string, detection_score double, "
    "source_bbox array<double>, pad_frac double, seed bigint, model_id string, output_image string"
)
PLACEMENTS = (
    "id string, bbox_index int, object string, source_bbox array<double>, bbox_area double, z_order int, "
    "reference_image string"
)
PLACEMENTS_MATCHED = (
    PLACEMENTS + ", num_matches bigint, num_inliers bigint, scale double, rotation_deg double, tx double, ty double, "
    "matrix array<array<double>>, accepted boolean, reject_reason string"
)
DEPTH = (
    "id string, image string, raw string, depth_type string, model_id string, depth_shape array<int>, "
    "depth_min double, depth_max double, image_width int, image_height int"
)
DATASET_MANIFEST = (
    "id string, caption string, gt_image string, canvas_image string, depth_image string, image_width string, "
    "image_height string, canvas struct<image:string>, depth struct<image:string>"
)
DETECTIONS = (
    "image_path string, class_id int, class_name string, confidence double, x1 double, y1 double, x2 double, y2 double"
)
CAPTIONS_META = "file_name string, text string"
CONTROL_PAIRS = "source string, target string, caption string"
VALIDATION_METRICS = "global_step bigint, loss double, elapsed_ms double, samples_dir string"
